"""Secret scan: base patterns, and strings that compress badly where a secret would stand.

Base spans, leftmost and non-overlapping for each kind: assign (a sensitive name, = or :, a value of 6 or more
characters), access (AKIA..., 20 or more), hex (24 or more lower-case hex digits); matches that fail a length are dropped.

The method adds spans of kind novel: for every run of 16 or more key characters, a digit among them, that stands within
CONTEXT characters after a sensitive word on its line (or what follows such a word within the run), the marginal cost is
measured: the bytes that a zstandard frame grows by when the run's longest part between / _ = - follows the text around it, the compressor being
primed with a dictionary trained on identifiers. These are IDENTIFIERS and the KNOWN commonest runs of letters on the lines of
all documents that have a sensitive word, each alone and joined as code joins them. Words and identifiers cost little,
random strings about a byte a character; a run whose part costs NOVELTY bytes a character or more, and has two character
classes at least, is reported. Spans that touch a base span are not added again. Offsets are code points, the end exclusive. Words,
runs and base spans are each read once, in order, so a text takes time in proportion to its length.

Null and empty texts have no spans; whole texts are scanned. Each row counts as one document: repeated rows and ids give
the same result each, a null id is carried along. Empty tables give no rows; other columns are not touched.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "novel")
#: The base patterns.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Words after which a random string is likely a secret.
SENSITIVE = (*NAMES, "credential", "private", "bearer", "auth", "access", "signature", "pwd", "key")
CONTEXT, AROUND, NOVELTY = 48, 256, 0.84
#: Identifiers of the corpus that the dictionary is trained on, and its bytes.
KNOWN, DICT_BYTES = 3000, 16384
_LETTERS = re.compile("[A-Za-z]{4,24}")
_NEAR = re.compile("|".join(SENSITIVE))
LEAST = 16
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
#: What joins words in names and paths; the longest part between them is measured, and has so many characters.
_PARTS, LEAST_PART = re.compile("[/_=-]"), 12
#: Names that code and its surroundings have often.
IDENTIFIERS = (
    "get set add remove update create delete find load save read write open close start stop user name value index count size length list map array "
    "string number object type class function method return result error message request response server client config option default path file "
    "data key token secret password auth access session account public private static const import export module test admin setting page folder "
    "home local share library application report document project source main build release version backup archive download upload interface "
    "factory manager service database connection pool timeout expires seconds encrypted information development environment production"
).split()


_LEAD = " ".join(IDENTIFIERS[::2]) + "\n"


def train(identifiers: list[str]) -> bytes:
    """A zstandard dictionary of the identifiers: each in lower and upper case, and joined to those after it as code does."""
    words = list(dict.fromkeys([*IDENTIFIERS, *(w.lower() for w in identifiers)]))
    entries = []
    for i, a in enumerate(words):
        b, c = words[(i + 1) % len(words)], words[(i + 2) % len(words)]
        entries.append(f"{a} {a.upper()} {a}_{b}_{c} {a}{b.title()}{c.title()} /{a}/{b.title()}/{c} {a.upper()}_{b.upper()} {a}-{b}{i % 30}".encode())
    try:
        return zstandard.train_dictionary(DICT_BYTES, entries, level=9).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(entries)[:DICT_BYTES]


@lru_cache(4)
def _press(dictionary: bytes):
    return zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_dict_id=False).compress


@lru_cache(1)
def plain_dictionary() -> bytes:
    return train([])


def marginal_cost(before: str, candidate: str, after: str = "", dictionary: bytes | None = None) -> float:
    """Compressed bytes that a character of candidate adds to the text around it."""
    press = _press(plain_dictionary() if dictionary is None else dictionary)
    # identifiers lead, so that even a short text is a block that zstandard compresses
    around = (_LEAD + after + "\n" + before).encode("utf-8", "replace")
    return (len(press(around + candidate.encode("utf-8", "replace"))) - len(press(around))) / max(1, len(candidate))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind as an index of KINDS, end), ordered."""
    found = []
    low = text.lower()
    if any(name in low for name in NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _classes(s: str) -> int:
    return any(c.isdigit() for c in s) + any(c.islower() for c in s) + any(c.isupper() for c in s)


def _lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c < "\x80" else c for c in text)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs, or ends of runs, that follow a sensitive word closely."""
    ends, k, found = [m.end() for m in _NEAR.finditer(_lowered(text))], 0, []
    for m in _RUN.finditer(text) if ends else ():
        start, end = m.span()
        while k < len(ends) and ends[k] <= start:
            k += 1
        if not (k and start - ends[k - 1] < CONTEXT and text.find("\n", ends[k - 1], start) < 0):
            start = ends[k] if k < len(ends) else end
        if end - start >= LEAST:
            found.append((start, end))
    return found


def novel_spans(text: str, base: list[tuple[int, int, int]], dictionary: bytes | None = None) -> list[tuple[int, int, int]]:
    starts, last = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    found = []
    for s, e in candidates(text):
        before = bisect_left(starts, e)
        run = max(_PARTS.split(text[s:e]), key=len)
        if before and last[before - 1] > s or len(run) < LEAST_PART or _classes(run) < 2 or not any("0" <= c <= "9" for c in run):
            continue
        if marginal_cost(text[max(0, s - AROUND) : s], run, text[e : e + AROUND], dictionary) >= NOVELTY:
            found.append((s, 3, e))
    return found


def as_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_text(text: str | None, dictionary: bytes | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base, dictionary))


def _identifiers(batches):
    for batch in batches:
        seen: Counter = Counter()
        for t in batch.column(0):
            text = t.as_py() or ""
            if _NEAR.search(_lowered(text)):
                for line in text.split("\n"):
                    if _NEAR.search(_lowered(line)):
                        seen.update(w.lower() for w in _LETTERS.findall(line))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


def corpus_dictionary(docs: DataFrame, text_col: str = "text", known: int = KNOWN) -> bytes:
    """Trained on the `known` commonest identifiers of the lines with a sensitive word, counted over all documents."""
    words = docs.select(F.col(text_col).alias("text")).mapInArrow(_identifiers, "word string, n long")
    top = words.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(known)
    return train([r["word"] for r in top.collect()])


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans."""
    dictionary = corpus_dictionary(docs, text_col)

    def run(batches):
        for batch in batches:
            found = [scan_text(t.as_py(), dictionary) for t in batch.column(1)]
            count = lambda k: pa.array([sum(x[1] == k for x in every) for _, every in found], pa.int64())
            digest = [hashlib.sha256(as_text(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column(0), **{f"n_{kind}": count(k) for k, kind in enumerate(KINDS)}, "base_sha256": pa.array(digest, pa.string()), "spans": pa.array([as_text(every) for _, every in found], pa.string())}
            )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
