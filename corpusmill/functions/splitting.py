"""Size-bounded recursive text splitting: the small per-text helper behind the chunking jobs."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Counter = Callable[[str], int]
# Separators in the order in which they are tried.
SEPARATORS = ("\n\n", "\n", " ", "")
LEGAL_SEPARATORS = ("\n\n\n", "\n\n", "\n", ".", " ", "")
PIECES = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_tokens", T.IntegerType())]))
PIECES_ARROW = pa.list_(pa.struct([("text", pa.string()), ("n_tokens", pa.int32())]))

SLICE_ROWS = 64

_TOKEN = re.compile(r"\w+|[^\w\s]")


def count_words(text: str) -> int:
    """Words and single punctuation marks; the same measure as ``text.token_count``."""
    return len(_TOKEN.findall(text))


def encoding_counter(name: str) -> Counter:
    """Tokens of a named byte-pair encoding. Its vocabulary must be present on the executors."""
    import tiktoken

    encoding = tiktoken.get_encoding(name)
    return lambda text: len(encoding.encode(text))


def _cut(text: str, separator: str) -> list[str]:
    """Pieces of a text; each but the first starts with the separator."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [piece for piece in (first, *(separator + r for r in rest)) if piece]


def _pack(run: Iterable[tuple[str, int]], size: int, overlap: int):
    """Join neighbouring pieces up to the size; the tail of a chunk opens the next one."""
    window: deque[tuple[str, int]] = deque()
    total = 0
    for piece, n in run:
        if window and total + n > size:
            yield "".join(p for p, _ in window)
            while total > overlap or (total and total + n > size):
                total -= window.popleft()[1]
        window.append((piece, n))
        total += n
    yield "".join(p for p, _ in window)


def split_text(text: str, size: int, overlap: int, count: Counter = count_words, separators=SEPARATORS) -> list[str]:
    """Chunks of at most ``size``, cut at the coarsest separator that occurs in the text."""
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    chunks: list[str] = []
    run: list[tuple[str, int]] = []
    for piece in _cut(text, separators[at]):
        n = count(piece)
        if n < size:
            run.append((piece, n))
            continue
        chunks += _pack(run, size, overlap)
        chunks += split_text(piece, size, overlap, count, finer) if finer else [piece]
        run = []
    chunks += _pack(run, size, overlap)
    return [c for c in map(str.strip, chunks) if c]


def recursive_split(
    df: DataFrame,
    sections: Column,
    size: Column | int,
    overlap: Column | int,
    keep: Column | int | None = None,
    separators: tuple[str, ...] = SEPARATORS,
    counter: Callable[[], Counter] | None = None,
    out: str = "_cut",
    spent: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``out`` array<struct<text,n_tokens>>: the sections of every row cut to size.

    A section of at most ``keep`` tokens (default: the size) stays whole; NULL sections give NULL. All columns travel
    through Python; those in ``spent`` are not needed any more and are left out.
    ``counter`` is called once per task and returns the length measure.
    """

    def column(value):
        return value if isinstance(value, Column) else F.lit(value)

    keep = size if keep is None else keep
    task = F.struct(
        sections.alias("sections"),
        column(size).cast("int").alias("size"),
        column(overlap).cast("int").alias("overlap"),
        column(keep).cast("int").alias("keep"),
    )

    def run(batches):
        count = counter() if counter else count_words

        def one(job):
            if job["sections"] is None:
                return None
            out = []
            for section in job["sections"]:
                n = count(section)
                if n <= job["keep"]:
                    out.append((section, n))
                else:
                    out += [(c, count(c)) for c in split_text(section, job["size"], job["overlap"], count, separators)]
            return [{"text": text, "n_tokens": n} for text, n in out]

        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):  # only these rows become Python values at once
                *kept, jobs = batch.slice(start, SLICE_ROWS).columns
                cut = pa.array([one(job) for job in jobs.to_pylist()], PIECES_ARROW)
                yield pa.RecordBatch.from_arrays([*kept, cut], [*batch.schema.names[:-1], out])

    schema = T.StructType([*[f for f in df.schema.fields if f.name not in spent], T.StructField(out, PIECES)])
    jobs = df.withColumn("_task", task)
    return (jobs.drop(*spent) if spent else jobs).mapInArrow(run, schema)
