"""Exact dedup by content-defined chunk recipes, with DataFrame operations only.

Texts are equal if they are identical without ASCII white space. Each normalised text is cut into chunks
where its content says so: after the first pair of characters of two fixed classes beyond ``MIN_CHUNK``
characters, or at ``MAX_CHUNK``; equal stretches are cut alike wherever they stand. A chunk's identifier is
its 64-bit hash, its length and a number that tells apart different chunks with equal hash and length. That
number is verified on the content: every distinct chunk is moved once, to the others of its hash, after
equal ones were merged in each task. A document's recipe is its ordered list of identifiers; equal recipes
mean equal texts. Only recipes are compared and joined, so a long document is never moved as a whole and no
chunk is moved twice.

Size: recipes hold about 16 bytes per 2000 characters and are written once to the shared folder with a row
number. A group of copies, however large, is summed in each task before its rows meet, and the rows get
their group's result by a join that Spark splits where a recipe is frequent.

Defined cases: a null text counts as empty, and empty texts equal each other; of equal texts the one with
most code points stays, then the smallest id (a null id comes last); of rows that also repeat the id, one
stays; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvgrid.llm.common import stage

MIN_CHUNK = 2048
MAX_CHUNK = 16384

_WHITE = " \t\n\x0b\x0c\r"


def _code_class(rest: int) -> str:
    """A regular expression class of the characters below 256 with this rest modulo 16."""
    return "[" + "".join(f"\\x{16 * k + rest:02X}" for k in range(16)) + "]"


#: A chunk ends with a character of the first class and one of the second; the last one may end anywhere.
CHUNK = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 2}}}?{_code_class(5)}{_code_class(3)}|.{{1,{MAX_CHUNK}}}"


def _normalised(text_col: str) -> Column:
    return F.translate(F.coalesce(F.col(text_col), F.lit("")), _WHITE, "")


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(id, row, n_chars, text_sha256, recipe) per document, written to the shared folder."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), _normalised(text_col).alias("_norm"))
    first = stage(rows.select(
        "id", F.monotonically_increasing_id().alias("row"), F.coalesce(F.length("_text"), F.lit(0)).alias("n_chars"),
        F.sha2("_norm", 256).alias("text_sha256"),
        F.transform(_chunks(F.col("_norm")), lambda c: F.struct(
            chunk_hash(c).alias("hash"), F.octet_length(c).alias("size"), F.lit(0).alias("no"))).alias("recipe")), "recipes")
    content = (rows.select(F.explode(_chunks(F.col("_norm"))).alias("chunk"))
               .select("chunk", chunk_hash(F.col("chunk")).alias("hash"), F.octet_length("chunk").alias("size")))
    distinct = content.groupBy("hash", "size", "chunk").agg(F.lit(1).alias("one"))
    clash = stage(distinct.groupBy("hash", "size").agg(F.count("*").alias("n")).where("n > 1").select("hash", "size"),
                  "clashes")
    if clash.isEmpty():
        return first
    # different chunks share a hash and a length: number them by content
    of_hash = Window.partitionBy("hash", "size").orderBy("chunk")
    numbers = (distinct.join(clash, ["hash", "size"], "left_semi")
               .select("hash", "size", "chunk", (F.row_number().over(of_hash) - 1).alias("number")))
    numbered = rows.withColumn("row", F.monotonically_increasing_id())  # before a row becomes several
    parts = stage(numbered.select(
        "id", "row", F.coalesce(F.length("_text"), F.lit(0)).alias("n_chars"), F.sha2("_norm", 256).alias("text_sha256"),
        F.posexplode_outer(_chunks(F.col("_norm"))).alias("pos", "chunk"))
        .withColumns({"hash": chunk_hash(F.col("chunk")), "size": F.octet_length("chunk")}), "chunk-rows")
    item = F.when(F.col("pos").isNotNull(), F.struct("pos", "hash", "size", F.coalesce("number", F.lit(0)).alias("no")))
    return stage(parts.join(numbers, ["hash", "size", "chunk"], "left")
                 .groupBy("id", "row", "n_chars", "text_sha256").agg(F.sort_array(F.collect_list(item)).alias("items"))
                 .select("id", "row", "n_chars", "text_sha256", F.transform("items", lambda i: F.struct(
                     i["hash"].alias("hash"), i["size"].alias("size"), i["no"].alias("no"))).alias("recipe")), "recipes")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     chunk_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: keep_id, group_size, kept, text_sha256."""
    rows = recipes(docs, id_col, text_col, chunk_hash)
    best = F.min(F.struct((-F.col("n_chars")).alias("chars"), F.col("id").isNull().alias("no_id"), "id", "row"))
    groups = (rows.groupBy("recipe").agg(best.alias("best"), F.count("*").alias("group_size"))
              .select("recipe", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size"))
    groups = stage(groups, "groups")  # so that the join's sides are plain scans, which Spark can split
    return (rows.join(groups, "recipe")
            .select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"),
                    "text_sha256"))
