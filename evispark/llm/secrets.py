"""Secrets in texts: known forms by pattern, and random strings by how badly a tokenizer's vocabulary compresses them.

Words and identifiers are made of pieces that a vocabulary knows, so they have many characters for each token; keys and passwords
made at random have few. Runs that are digests, ids or compound names are put aside first, as they are no secrets
however random they look.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of known forms, and how long a match (of assign: its value) has to be.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: The kinds of spans in order; the last is the method's own.
KINDS = ("assign", "access", "hex", "random")

#: Runs of at least so many characters with fewer than so many characters for each token are random.
LEAST_RUN, MOST_RATIO = 20, 2.0
#: Characters that are encoded in one go, as the tokenizer's time grows faster than a single word's length.
PIECE = 256
#: Lengths of hexadecimal digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))

_assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# Runs are maximal, so asking for the length at once finds the same ones as dropping short matches.
_access = re.compile(rf"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}")
_hex = re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}")
_run = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
_uuid = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_named_digest = re.compile(r"(?:md5|sha-?(?:1|224|256|384|512))[-:=]?$", re.IGNORECASE)
_starts_as_digest = re.compile(r"(?:md5|sha(?:1|224|256|384|512))[-=]", re.IGNORECASE)
# Names of words in lower, upper or mixed case, each with at most four figures, with marks between them.
_PART = r"(?:(?:[A-Z]{0,6}[a-z]{2,}(?:[A-Z]{1,6}[a-z]{2,})*|[A-Z]{2,})[0-9]{0,4}|[0-9]{1,4})"
_compound = re.compile(rf"[_/+=-]*{_PART}(?:[_/+=-]+{_PART})*[_/+=-]*")
_figures = re.compile(r"[0-9+/_=-]+")


def _is_known(text: str, start: int, run: str) -> bool:
    """Whether a run is a digest or an identifier: all figures, letters of one word form, a UUID, a compound name, or a part of a URL's path."""
    letters = run.replace("-", "").replace("_", "")
    if letters.isalpha() and (letters.islower() or letters.isupper() or letters.istitle()) or _figures.fullmatch(run):
        return True
    bare = run.strip("=-_/+")
    if len(bare) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", bare) or _uuid.fullmatch(bare):
        return True
    if _starts_as_digest.match(run) or _named_digest.search(text, max(0, start - 8), start):
        return True
    word = text[max(0, start - 2048) : start]
    word = word[max(word.rfind(c) for c in " \n\t") + 1 :]
    if "://" in word + run[:3] and "?" not in word or run.startswith("//"):
        return True
    return _compound.fullmatch(run) is not None


class Scanner:
    """Finds the secrets of texts with the vocabulary of a tiktoken file."""

    #: Fixed value: the pattern of the vocabulary's own words, for files that have none.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        self.vocabulary = tiktoken.Encoding("secrets", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ratio(self, run: str) -> float:
        """Characters for each token."""
        return len(run) / sum(len(self.vocabulary.encode_ordinary(run[i : i + PIECE])) for i in range(0, len(run), PIECE))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end) of all secrets, ascending, in code points."""
        found = [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= LEAST_VALUE] if ":" in text or "=" in text else []
        found += [(m.start(), 1, m.end()) for m in _access.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
        own = []
        for m in _run.finditer(text):
            a, b = m.span()
            if any(s < b and a < e for s, _, e in found) or _is_known(text, a, m[0]):
                continue
            if self.ratio(m[0]) < MOST_RATIO:
                own.append((a, 3, b))
        return sorted(found + own)


_SCANNERS: dict[str, Scanner] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def find(docs: DataFrame, keep: list[str] = ("doc_id",), vocabulary: str | None = None) -> DataFrame:
    """``keep`` and ``secrets``, an array of (kind, start, end, secret), for each row; ``start`` and ``end`` are in code points.

    Known forms are matched from the left without overlaps within a kind; random strings are runs that overlap none of
    them. Spans are ordered by start, then by kind in the order of KINDS. Null and empty texts have no secret. Equal
    rows have equal results, and an empty table has an empty one. ``secrets`` takes the place of a kept column of that
    name. Whole texts are read, one at a time. ``vocabulary`` is a tiktoken file that every executor can read.
    """
    keep = [c for c in keep if c != "secrets"]
    path = vocabulary or default_vocabulary()
    schema = docs.select(*keep).schema
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _SCANNERS:
            _SCANNERS[path] = Scanner(path)
        scanner = _SCANNERS[path]
        for batch in batches:
            found = []
            for value in batch.column(len(keep)):
                text = value.as_py() or ""
                found.append([{"kind": KINDS[k], "start": a, "end": b, "secret": text[a:b]} for a, k, b in scanner.spans(text)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, kinds)], [*keep, "secrets"])

    kept = "".join(f"`{c}` {schema[c].dataType.simpleString()}, " for c in keep)
    asked = docs.select(*(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)), F.col("text").alias("_text"))
    return asked.mapInArrow(run, f"{kept}secrets array<struct<kind:string,start:bigint,end:bigint,secret:string>>")


def redacted(text: Column, secrets: Column) -> Column:
    """A text with ``[kind]`` in place of each of its secrets; of spans that overlap, what lies after the first is cut too."""
    cut = F.aggregate(
        secrets,
        F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("at")),
        lambda s, x: F.when(
            x["start"] >= s["at"],
            F.struct(F.concat(s["done"], F.substr(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.lit("["), x["kind"], F.lit("]")).alias("done"), x["end"].alias("at")),
        ).otherwise(F.struct(s["done"].alias("done"), F.greatest(s["at"], x["end"]).alias("at"))),
    )
    return F.concat(cut["done"], F.substr(text, (cut["at"] + 1).cast("int")))


def scanned(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document (see ``find``), and n_random."""
    found = find(docs, ["doc_id"], vocabulary)
    of = lambda kind: F.filter("secrets", lambda x: x["kind"] == kind)
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(listed(F.filter("secrets", lambda x: x["kind"] != KINDS[-1])), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )
