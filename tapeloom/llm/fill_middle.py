r"""Fill-in-the-middle: a text's tokens are cut into prefix, middle and suffix, and the middle goes last.

The cutting is DuckDB SQL inside mapInArrow: each batch of pieces is registered as it is, SQL returns Arrow, and no Python
runs for a row. A batch holds at most BATCH bytes of text; a longer text is cut into pieces between tokens, whose counts add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

#: Fixed values of the contract: tokens, the texts that mark the three parts, seed, percent that is changed, percent of it with the suffix first.
TOKEN = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
CHANGED, SUFFIX_FIRST = 90, 20
#: Bytes of text in one query, and of a piece of a longer text.
BATCH, PIECE = 4 << 20, 1 << 20

COUNT = f"SELECT len(regexp_extract_all(text, '{TOKEN}'))::BIGINT AS m, contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') AS marked FROM pieces"
DRAW = f"""
WITH d AS (SELECT sha256('{{seed}}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM ids)
SELECT {", ".join(f"('0x' || substr(h, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))} FROM d"""
#: a and b: how many of a piece's tokens come before the middle and before the suffix.
CUT = f"""
WITH t AS (SELECT regexp_extract_all(text, '{TOKEN}') AS tokens, a, b FROM cuts)
SELECT coalesce(array_to_string(list_slice(tokens, 1, a), ''), '') AS prefix, coalesce(array_to_string(list_slice(tokens, a + 1, b), ''), '') AS middle,
       coalesce(array_to_string(list_slice(tokens, b + 1, len(tokens)), ''), '') AS suffix FROM t"""
JOIN = f"""
SELECT CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
       ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS fim_text,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars FROM parts"""
#: A text that is not plain holds no marker, and none can begin in a text and end in a marker, so the first find is the right one.
RESTORE = f"""
WITH s AS (SELECT fim_text, form, strpos(fim_text, CASE form WHEN 'psm' THEN '{SUFFIX}' ELSE '{PREFIX}' END) AS k, strpos(fim_text, '{MIDDLE}') AS m FROM formatted),
p AS (SELECT *, substr(fim_text, 4, k - 4) AS one, substr(fim_text, k + 3, m - k - 3) AS two, substr(fim_text, m + 3) AS middle FROM s)
SELECT CASE form WHEN 'plain' THEN fim_text WHEN 'psm' THEN one || middle || two WHEN 'spm' THEN two || middle || one END AS text FROM p"""


def database() -> duckdb.DuckDBPyConnection:
    """A database in memory, one thread, without files of its own."""
    return duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "autoload_known_extensions": False, "preserve_insertion_order": True})


def asked(con: duckdb.DuckDBPyConnection, sql: str, **tables: pa.Table) -> pa.Table:
    for name, t in tables.items():
        con.register(name, t)
    found = con.sql(sql).to_arrow_table()
    for name in tables:
        con.unregister(name)
    return found


def cut_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """texts in pieces of about PIECE bytes, and the row of each piece. Cuts are before bytes that are neither ASCII letters nor
    inside a character, so that no token is cut; an unbroken run of letters is one token and stays whole."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    if not len(sizes) or sizes.max() <= PIECE:
        return texts, np.arange(len(sizes))
    found, rows = [], []
    for row, size in enumerate(sizes):
        if size <= PIECE:
            found.append(texts.slice(row, 1))
            rows.append(row)
            continue
        data = texts[row].as_buffer()
        b = np.frombuffer(data, np.uint8)
        at = 0
        while at < size:
            end = at + PIECE
            while end < size:
                near = b[end : end + 65_536]
                open_ = np.nonzero(~(((near | 32) >= 97) & ((near | 32) <= 122)) & ((near & 0xC0) != 0x80))[0]
                if len(open_):
                    end += int(open_[0])
                    break
                end += len(near)
            end = min(end, int(size))
            found.append(pa.array([data[at:end].to_pybytes()], pa.binary()).cast(pa.string()))
            rows.append(row)
            at = end
    return pa.chunked_array([x.cast(pa.string()) for x in found]).combine_chunks(), np.array(rows)


def groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items with at most `most` bytes, or one item each."""
    upto, at = np.concatenate([[0], np.cumsum(sizes)]), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + most, "right")) - 1)
        yield at, end
        at = end


def transform(con: duckdb.DuckDBPyConnection, ids: pa.Array, texts: pa.Array, seed: int) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars and fim_text of some texts."""
    pieces, row = cut_pieces(texts)
    sizes = pc.binary_length(pieces).to_numpy(zero_copy_only=False)
    parts = list(groups(sizes, BATCH))
    counted = pa.concat_tables([asked(con, COUNT, pieces=pa.table({"text": pieces.slice(a, z - a)})) for a, z in parts])
    m = counted["m"].to_numpy()
    starts = np.searchsorted(row, np.arange(len(texts)))
    n = np.add.reduceat(m, starts)
    marked = np.logical_or.reduceat(counted["marked"].to_numpy(), starts)
    draw = asked(con, DRAW.format(seed=seed), ids=pa.table({"doc_id": ids}))
    h = [draw[f"h{i}"].to_numpy() for i in (1, 2, 3, 4)]
    first, second = np.minimum(h[0] % (n + 1), h[1] % (n + 1)), np.maximum(h[0] % (n + 1), h[1] % (n + 1))
    plain = (n == 0) | marked | (h[2] % 100 >= CHANGED)
    form = pa.array(np.where(plain, "plain", np.where(h[3] % 100 < SUFFIX_FIRST, "spm", "psm")).tolist(), pa.string())
    before = np.cumsum(m) - m
    before -= before[starts][row]
    a, b = np.clip(first[row] - before, 0, m), np.clip(second[row] - before, 0, m)
    cut = pa.concat_tables([asked(con, CUT, cuts=pa.table({"text": pieces.slice(s, z - s), "a": a[s:z], "b": b[s:z]})) for s, z in parts])
    if len(row) > len(texts):  # the pieces of long texts
        lists = lambda c: pa.ListArray.from_arrays(pa.array([*starts, len(row)], pa.int32()), cut[c].combine_chunks().cast(pa.string()))
        cut = pa.table({c: pc.binary_join(lists(c), "") for c in cut.column_names})
    whole = cut.append_column("text", texts).append_column("form", form)
    done = asked(con, JOIN, parts=whole)
    return [pa.array(n.astype(np.int64)), form, *(done[c].combine_chunks().cast(pa.int64()) for c in ("prefix_chars", "middle_chars")), done["fim_text"].combine_chunks().cast(pa.string())]


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n, form, prefix_chars, middle_chars, fim_text.

    n: tokens. form: plain (fim_text is the text, no lengths), psm or spm. A null text is empty, and an empty one is plain; a
    null doc_id draws as an empty one would. Rows stay as they are and may repeat: the draw depends on doc_id alone. Other columns
    are not looked at; an empty table gives an empty result. A text of any length that Spark holds in a row is cut in pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = database()
        for batch in batches:
            for a, z in groups(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), BATCH):
                ids, texts = batch.column("doc_id").slice(a, z - a), batch.column("text").slice(a, z - a)
                yield pa.RecordBatch.from_arrays([ids, *transform(con, ids, texts, seed)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "fim_text"])
        con.close()

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, fim_text string")


def restore(formatted: DataFrame) -> DataFrame:
    """formatted (form, fim_text and any others) with `text`, the text that fim_text was made of; a column text is replaced.

    A null fim_text or form gives a null text; rows may repeat, an empty table gives an empty result.
    """
    given = formatted.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = database()
        for batch in batches:
            for a, z in groups(np.nan_to_num(pc.binary_length(batch.column("fim_text")).to_numpy(zero_copy_only=False)), BATCH):
                part = batch.slice(a, z - a)
                text = asked(con, RESTORE, formatted=pa.table({c: part.column(c) for c in ("fim_text", "form")}))["text"]
                yield pa.RecordBatch.from_arrays([*part.columns, text.combine_chunks().cast(pa.string())], [*part.schema.names, "text"])
        con.close()

    return given.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema) + ", text string")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("fim_text", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
e AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y, ('0x' || h[17:24])::BIGINT % 100 AS z,
         ('0x' || h[25:32])::BIGINT % 100 AS v FROM d),
f AS (
  SELECT *, CASE WHEN text = '' OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' OR z >= 90 THEN 'plain' WHEN v < 20 THEN 'spm' ELSE 'psm' END AS form,
         length(array_to_string(u[1:least(x, y)], '')) AS p, length(array_to_string(u[1:greatest(x, y)], '')) AS q FROM e)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN coalesce(p, 0) END AS prefix_chars, CASE WHEN form <> 'plain' THEN coalesce(q, 0) - coalesce(p, 0) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || left(text, coalesce(p, 0)) || '<S>' || substr(text, coalesce(q, 0) + 1) || '<M>' || substr(text, coalesce(p, 0) + 1, coalesce(q, 0) - coalesce(p, 0))
         ELSE '<S>' || substr(text, coalesce(q, 0) + 1) || '<P>' || left(text, coalesce(p, 0)) || '<M>' || substr(text, coalesce(p, 0) + 1, coalesce(q, 0) - coalesce(p, 0)) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM f
"""
