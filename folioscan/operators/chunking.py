"""Structure-aware chunking: one pass over a text's lines finds its headings, segments and pieces; nothing is shuffled."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T

SEPARATORS = ("\n\n", "\n", ". ", " ", "")
TOP, ARTICLE = (re.compile(p, re.ASCII) for p in (T.HEADING_TOP, T.HEADING_ARTICLE))
#: Rows and characters of a batch of chunks that a task hands over.
BATCH_ROWS, BATCH_CHARS = 4096, 8 << 20


def line_level(line: str) -> int | None:
    """0 for titles, parts, chapters and sections, 1 for articles, None for other lines."""
    return 0 if TOP.match(line) else 1 if ARTICLE.match(line) else None


def text_headings(text: str) -> list[tuple[int, int, int, str]]:
    """(line, first character from 1, level, heading) of each line that begins a segment.

    With more than three blocks between blank lines, the first lines of blocks that are headings; else heading lines that
    follow a blank line, the end of a sentence or a line of fewer than five characters.
    """
    found, blocks, pos, before = [], 0, 1, None
    for k, line in enumerate(text.split("\n")):
        free, bare = not before, line.strip(" ")
        blocks += bool(bare) and free
        if (level := line_level(line)) is not None and (free or before[-1] in ".;:!?" or len(before) < 5):
            found.append((k, pos, level, bare, free))
        pos, before = pos + len(line) + 1, bare
    return [f[:4] for f in found if f[4] or blocks <= 3]


def text_segments(text: str) -> Iterator[tuple[int, list[str], str]]:
    """(first character from 1, active headings, body) of each segment: from a heading to the next, and what comes before the first.

    Segments that are their heading alone are dropped; a text without headings is one segment with no active heading.
    """
    found = text_headings(text)
    ends = [pos for _, pos, _, _ in found] + [len(text) + 1]
    if lead := text[: ends[0] - 1].strip():
        yield 1, [], lead
    top: list[str] = []
    for (_, pos, level, heading), end in zip(found, ends[1:], strict=True):
        top = [heading] if level == 0 else top
        body = text[pos - 1 : end - 1].strip()
        if body and body != heading:
            yield pos, top if level == 0 else [*top, heading], body


def _rows(docs: DataFrame, columns: list[str], text: str, schema: str, find: Callable[[str], Iterator[tuple]]) -> DataFrame:
    """columns of docs and what find(text) gives, a row for each; null texts have none. Rows leave in batches of bounded size."""
    kept = docs.select(*columns, F.col(text).alias("_text"))
    own = StructType([docs.schema[c] for c in columns])
    full = StructType([*own.fields, *StructType.fromDDL(schema).fields])
    names = [f.name for f in full.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(full)
        for b in batches:
            at, held, chars = [], [], 0

            def batch(b=b):
                mine = [c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]]
                new = [pa.array(v, kinds.field(len(mine) + k).type) for k, v in enumerate(zip(*held, strict=True))]
                return pa.RecordBatch.from_arrays([*mine, *new], names)

            for i, t in enumerate(b.column(b.num_columns - 1)):
                for row in find(t.as_py()) if t.is_valid else ():
                    at.append(i)
                    held.append(row)
                    chars += len(row[-1])
                    if len(at) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield batch()
                        at, held, chars = [], [], 0
            if at:
                yield batch()

    return kept.mapInArrow(run, full)


def headings(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, ord, pos, level, heading: the lines that begin a segment, as text_headings()."""
    return _rows(docs, [key], text, "ord int, pos long, level int, heading string", text_headings)


def segments(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, pos, path, body: the segments of each text, as text_segments()."""
    return _rows(docs, [key], text, "pos long, path array<string>, body string", text_segments)


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most size characters, cut at the coarsest separator that is there, each starting with up to overlap characters of the one before."""
    sep, finer = next(((s, separators[i + 1 :]) for i, s in enumerate(separators) if not s or s in text), ("", ()))
    parts = list(text) if not sep else [p for p in text.split(sep) if p]
    out, held, n = [], [], 0

    def flush():
        piece = sep.join(held).strip()
        if piece:
            out.append(piece)

    for p in parts:
        if len(p) > size and finer:
            if held:
                flush()
                held, n = [], 0
            out += split_text(p, size, overlap, finer)
            continue
        if held and n + len(sep) + len(p) > size:
            flush()
            while held and (n > overlap or n + len(sep) + len(p) > size):
                n -= len(held.pop(0)) + (len(sep) if held else 0)
        n += len(p) + (len(sep) if held else 0)
        held.append(p)
    if held:
        flush()
    return out


def text_chunks(text: str, tokens: int, overlap: int) -> Iterator[tuple[int, list[str], str, str]]:
    """(number from 0, active headings, the opening of its segment, piece) of each chunk."""
    n, budget = 0, 4 * tokens
    for _, path, body in text_segments(text):
        opening = body[:200]
        for piece in [body] if len(body) <= budget else split_text(body, budget, 4 * overlap):
            yield n, path, opening, piece
            n += 1


def chunk(docs: DataFrame, key: str, text: str = "text", meta: str | None = None, tokens: int = 500, overlap: int = 50) -> DataFrame:
    """key, chunk_index, text, token_count, embed_text, heading_path, cross_refs, is_definition of every chunk of non-blank texts."""
    columns = [key, meta] if meta else [key]
    s = _rows(docs, columns, text, "chunk_index int, path array<string>, opening string, piece string", lambda t: text_chunks(t, tokens, overlap))
    return s.select(
        key,
        "chunk_index",
        F.col("piece").alias("text"),
        T.token_count(F.col("piece")).alias("token_count"),
        T.embed_text(F.col(meta) if meta else F.lit(""), F.col("path"), F.col("piece")).alias("embed_text"),
        F.col("path").alias("heading_path"),
        T.cross_references(F.col("piece")).alias("cross_refs"),
        T.is_definition(F.col("path"), F.col("opening")).alias("is_definition"),
    )
