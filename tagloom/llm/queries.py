"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tagloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op10_decontamination")
def op10(spark, d):
    from tagloom.llm.fm_index import find_passages

    found = find_passages(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op4_packing")
def op4(spark, d):
    import public_tokenizers
    from tagloom.llm.packing import pack_documents

    path = public_tokenizers.path("byte_bpe_50k.json")
    return pack_documents(table(spark, d, "documents"), path)


@query("op6_pii")
def op6(spark, d):
    from tagloom.llm.pii import find_personal_data

    return find_personal_data(table(spark, d, "documents"))


@query("op2_compression_quality")
def op2(spark, d):
    from tagloom.llm.common import remainder
    from tagloom.llm.compression_quality import fit, score

    docs, held_out = table(spark, d, "documents"), remainder("doc_id", 3) == 1
    return score(docs, fit(docs, table(spark, d, "labels"), ~held_out), held_out)


@query("op3_toxicity")
def op3(spark, d):
    from tagloom.llm.common import remainder
    from tagloom.llm.toxicity import fit, score

    docs, held_out = table(spark, d, "documents"), remainder("doc_id", 5) == 0
    return score(docs, fit(docs, table(spark, d, "labels"), ~held_out), held_out)


@query("op9_secrets")
def op9(spark, d):
    from tagloom.llm.secrets import find_secrets

    return find_secrets(table(spark, d, "documents"))


def _line_oracle() -> str:
    from tagloom.llm.line_templates import ORACLE

    return ORACLE


@query("op1_line_templates", _line_oracle())
def op1(spark, d):
    from tagloom.llm.line_templates import line_report, repeated_lines

    docs = table(spark, d, "documents")
    return line_report(docs, repeated_lines(docs))


@query("op8_jaccard_join")
def op8(spark, d):
    from tagloom.llm.jaccard_join import jaccard_groups

    return jaccard_groups(table(spark, d, "documents"))


@query("op7_ngram_lm")
def op7(spark, d):
    from tagloom.llm.common import remainder
    from tagloom.llm.ngram_lm import score_documents

    return score_documents(table(spark, d, "documents"), remainder("doc_id", 7) == 2)


@query("op5_embedding_links")
def op5(spark, d):
    from tagloom.llm.embedding_links import link_embeddings

    return link_embeddings(table(spark, d, "embeddings"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """The documents of op13's contract: where h = crc32(doc_id) is divisible by ten, the words from a on repeat p words."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    planted = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    planted = planted.withColumn("words", words).withColumn("n", F.size("words"))
    planted = planted.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    planted = planted.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))

    def word(w, i):
        moved = F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))
        return F.when(i < F.col("a"), w).otherwise(moved)

    text = F.when(F.col("n") > 0, F.array_join(F.transform("words", word), " ")).otherwise(F.col("text"))
    return planted.select("doc_id", text.alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """The greatest run by length / period, compared exactly, and digests of the runs and of the text."""
    def greater(x, y):
        left, right = x["length"] * y["period"], y["length"] * x["period"]
        smaller = F.struct(x["start"], x["period"]) < F.struct(y["start"], y["period"])
        return F.when(left > right, -1).when(left < right, 1).when(smaller, -1).otherwise(1)

    best = F.get(F.array_sort("runs", greater), 0)
    line = lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{k}").alias(k) for k in ("start", "length", "period")],
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


@query("op13_periodic_runs")
def op13(spark, d):
    from tagloom.llm.periodic_runs import find_runs

    return run_digest(find_runs(with_periodic_tails(table(spark, d, "documents"))))


def _warc_oracle() -> str:
    from tagloom.llm.warc import ORACLE

    return ORACLE


@query("op12_warc_revisits", _warc_oracle())
def op12(spark, d):
    from tagloom.llm.warc import archive_pages

    found = archive_pages(table(spark, d, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def with_deleted_letters(doc_id, run):
    """The words of op11's contract: where h = crc32(doc_id:run) is divisible by 97, letter h % length goes."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % 97 == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


@query("op11_spelling_variants")
def op11(spark, d):
    from tagloom.llm.spelling import spelling_variants

    return spelling_variants(table(spark, d, "documents"), with_deleted_letters)
