"""Queries of the training-text operators; each takes a session and a folder of tables."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import table
from ..session import spread, stage_table
from . import duplicates, encoding, languages, leaks, mixture, pieces, pii, sentences, tokens


def _docs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select(*columns))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf, "doc_id", "raw_text", "text", "lang")
    return languages.label_documents(docs, languages.fit(docs), encoding.fit(docs))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return languages.mislabelled(_labelled(spark, sf)).select("doc_id", "seg_no", "lang")


def p1_languages(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).select("doc_id", "seg_no", "lang", F.round("confidence", 6).alias("confidence"), "start_char", "end_char")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked_items(_docs(spark, sf, "doc_id", "raw_text"), table(spark, sf, "eval_items")).select("item_id", "doc_id")


def p2_tolerant(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.tolerant_overlaps(_docs(spark, sf, "doc_id", "raw_text"), table(spark, sf, "eval_items")).select("item_id", "doc_id", F.round("share", 6).alias("share"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf, "doc_id", "raw_text")
    evidence = sentences.corpus_evidence(docs)
    wanted = docs.join(table(spark, sf, "sentence_review").select("doc_id").distinct(), "doc_id", "left_semi")
    return sentences.sentences(wanted, evidence).select("doc_id", "start_char", "end_char")


def p3_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentences(_docs(spark, sf, "doc_id", "raw_text"))


def _personal(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Documents with their spans, and windows with theirs as rows."""
    docs, windows = _docs(spark, sf, "doc_id", "raw_text"), table(spark, sf, "text_windows")
    lexicon = pii.learn_names(docs)
    spans = stage_table(pii.find_spans(docs, lexicon), "spans")
    return docs, windows, spans, pii.window_spans(windows, docs, spans, lexicon, pieces.locate_windows(windows, docs))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    _, _, spans, in_windows = _personal(spark, sf)
    in_docs = spans.select(F.lit("documents").alias("found_in"), F.col("doc_id").alias("row_id"), F.explode("spans").alias("s")).select("found_in", "row_id", "s.*")
    return in_docs.unionByName(in_windows.select(F.lit("text_windows").alias("found_in"), F.col("window_id").alias("row_id"), "start_char", "end_char", "pii_type"))


def p4_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and windows with placeholders. The key is the owner's: spark.spanloom.pii.key of the session, else one of this run alone."""
    key = spark.conf.get("spark.spanloom.pii.key", None)
    secret = key.encode() if key else secrets.token_bytes(32)
    docs, windows, spans, in_windows = _personal(spark, sf)
    of = in_windows.groupBy("window_id").agg(F.collect_list(F.struct("start_char", "end_char", "pii_type")).alias("spans"))  # as many as a window holds
    parts = {
        "documents": (pii.redact(docs.select("doc_id", "raw_text").join(spans, "doc_id"), secret, "doc_id", "raw_text"), "doc_id"),
        "text_windows": (pii.redact(windows.select("window_id", "text").join(of, "window_id", "left"), secret, "window_id", "text"), "window_id"),
    }
    each = [d.select(F.lit(name).alias("found_in"), F.col(i).alias("row_id"), "redacted", "n_spans") for name, (d, i) in parts.items()]
    return each[0].unionByName(each[1])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.duplicate_members(_docs(spark, sf, "doc_id", "raw_text"))


def p5_copies(spark: SparkSession, sf: str) -> DataFrame:
    return duplicates.collapse(_docs(spark, sf, "doc_id", "raw_text"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.cut_windows(table(spark, sf, "text_windows"), table(spark, sf, "window_limits")).where("n_pieces > 1").select("window_id").distinct()


def p6_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.split_windows(table(spark, sf, "text_windows"), table(spark, sf, "window_limits"), table(spark, sf, "documents"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode_corpus(_docs(spark, sf, "doc_id", "text"))


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return mixture.mix(_docs(spark, sf, "doc_id", "source", "text"), table(spark, sf, "mix_targets"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1].where("short").select("source")


def p8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    shares = ("rate", "expected_share", "drawn_share", "agreement", "residual")
    return _mixed(spark, sf)[1].drop("mixed_tokens", "at_cap").withColumns({c: F.round(c, 6) for c in shares})


def p8_drawn(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[0]


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf, "doc_id", "text")
    return encoding.repair_texts(docs, encoding.fit(docs)).select("doc_id")


def p9_repaired(spark: SparkSession, sf: str) -> DataFrame:
    docs = _docs(spark, sf, "doc_id", "text")
    return encoding.repair_texts(docs, encoding.fit(docs)).withColumn("mistakes", F.concat_ws(" > ", "mistakes"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_languages, p2_found, p2_tolerant, p3_found, p3_sentences, p4_found, p4_redacted, p5_found, p5_copies, p6_found, p6_pieces, p7_ids, p8_found, p8_mixture, p8_drawn, p9_found, p9_repaired)
}

#: Results that plain SQL can give on whole tables.
ORACLE = {
    "p6_found": """
        SELECT DISTINCT w.window_id FROM text_windows w JOIN window_limits l USING (profile)
        WHERE w.text IS NOT NULL AND length(w.text) > l.max_chars""",
}
