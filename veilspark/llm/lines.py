"""Removal of repeated multi-line chunks, with DataFrame functions only.

A rolling hash over the hashes of the last lines ends a chunk at one line in two, so boundaries
depend on nearby lines alone and shift with inserted text. This is done once for each of WINDOWS
(how many lines the hash spans), with another bit of the hash each: a passage that other lines
surround has chunks of its own in one or other of them, almost up to its ends. Of chunks of two
lines or more that stand at several places, equal byte for byte, the first (least doc_id, then
line) stays; the lines of the others are removed. A line goes only where an earlier one is equal,
so one copy of every line is left.

Only hashes are grouped over all chunks. The texts of chunks whose hash occurs twice are then
compared as grouping and join keys; a bitmap of fixed size keeps the others out of the shuffle.

Defined cases: a null text stays null and has no lines; an empty text is one empty line; a row
without doc_id is not compared and loses nothing; repeated rows of one document and text count
as one place; a text that is removed entirely becomes empty; an empty table gives an empty
result; columns may have any names, those that are not text are returned unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import _tables

WINDOWS = (1, 1, 1, 1, 1, 2)


def _ends(level: int, window: int) -> str:
    """Numbers of the lines that end a chunk, of a.l (lines) and a.h (their hashes)."""
    roll = "a.h[i]" + "".join(f" ^ if(i >= {k}, shiftleft(a.h[greatest(i - {k}, 0)], {k}), 0L)" for k in range(1, window))
    return f"filter(sequence(0, size(a.l) - 1), i -> i = size(a.l) - 1 or shiftright({roll}, {20 + level}) & 1 = 0)"


def _chunks(text: str, windows: tuple[int, ...]) -> Column:
    """array<struct<place:int,n_lines:int,chunk:string>>: the chunks of two lines or more of a text column; place is a chunk's first line."""
    levels = [
        f"""transform(array({_ends(level, window)}), e -> filter(transform(e, (x, k) -> named_struct(
            'place', if(k = 0, 0, e[greatest(k - 1, 0)] + 1), 'n_lines', x - if(k = 0, -1, e[greatest(k - 1, 0)]))), c -> c.n_lines > 1))[0]"""
        for level, window in enumerate(windows)
    ]
    return F.expr(f"""
      transform(
        transform(array(split({text}, '\\n', -1)), l -> named_struct('l', l, 'h', transform(l, x -> cast(conv(substring(md5(x), 1, 15), 16, 10) as bigint)))),
        a -> transform(array_distinct(concat({", ".join(levels)})), c -> named_struct(
          'place', c.place, 'n_lines', c.n_lines, 'chunk', array_join(slice(a.l, c.place + 1, c.n_lines), '\\n'))))[0]""")


def _free(name: str, taken: list[str]) -> str:
    return name if name not in taken else _free(name + "_", taken)


def remove_repeated_chunks(docs: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """docs with text as it is left, and n_lines, n_removed (lines, long); where docs has such a column, with "_" after the name."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    chunks = known.select("doc_id", F.xxhash64("text").alias("th"), F.explode(_chunks("text", windows)).alias("c")).select("doc_id", "th", "c.*", F.xxhash64("c.chunk").alias("h"))
    again = _tables.written(chunks.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "hashes")
    # Written, so that each text is cut once, and so that the join deals both sides itself and can split a chunk that very many documents share.
    alike = _tables.written(_tables.likely(chunks, "h", again), "chunks")
    firsts = _tables.written(alike.groupBy("h", "chunk").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "chunk", "first"), "firsts")
    gone = alike.join(firsts.hint("merge"), ["h", "chunk"]).where("struct(doc_id, place) > first")
    gone = gone.groupBy("doc_id", "th").agg(F.collect_set(F.struct("place", "n_lines")).alias("lost"))
    lost = F.expr("array_distinct(flatten(transform(lost, c -> sequence(c.place, c.place + c.n_lines - 1))))")
    gone = _tables.written(gone.select(F.col("doc_id").alias("__veil_doc"), F.col("th").alias("__veil_th"), lost.alias("__veil_lost")), "lost")
    _tables.dropped(again, alike, firsts)

    # Only documents that may lose lines are shuffled; the join is a merge join at every size.
    touched, clear = _tables.parted(docs, "doc_id", gone.select(F.col("__veil_doc").alias("doc_id")))
    marked = touched.join(gone.hint("merge"), (F.col("doc_id").cast("long") == F.col("__veil_doc")) & (F.xxhash64("text") == F.col("__veil_th")), "left").drop("__veil_doc", "__veil_th")
    marked = marked.unionByName(clear, allowMissingColumns=True)
    left = F.expr("array_join(transform(array(split(text, '\\n', -1)), l -> transform(array_except(sequence(0, size(l) - 1), __veil_lost), i -> l[i]))[0], '\\n')")
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long")
    text = F.when(F.col("__veil_lost").isNull(), F.col("text")).otherwise(left)
    counts = n_lines.alias(_free("n_lines", docs.columns)), F.coalesce(F.size("__veil_lost"), F.lit(0)).cast("long").alias(_free("n_removed", docs.columns))
    return marked.select(*(text.alias("text") if c == "text" else F.col(c) for c in docs.columns), *counts)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeated_chunks(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
