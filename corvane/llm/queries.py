"""Queries of problems 2 to 9, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import canonical, languages, mixing, near_duplicates, pii, splitting, subjects, tokens
from corvane.sources.tables import table

# Every character that counts as white space; patterns that Java and RE2 both read.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BLANK_LINE = r"(?:\r\n?|\n)[^\S\r\n]*(?:\r\n?|\n)"
EDGES = f"^{SPACE}+|{SPACE}+$"
MARKUP = r"\n(?:#|<)"


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """The language stretches of comments whose label is missing or wrong, or that have several."""
    return languages.relabelled(table(spark, directory, "comments"), table(spark, directory, "lang_codes"))


def p2_stretches(spark: SparkSession, directory: str) -> DataFrame:
    """Every stretch of every comment, with its confidence."""
    comments, codes = table(spark, directory, "comments"), table(spark, directory, "lang_codes")
    return languages.label_languages(comments, languages.train_languages(comments, codes)).distinct()


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of comments that look the same and differ in characters."""
    return canonical.look_alike_pairs(table(spark, directory, "comments"))


def p3_forms(spark: SparkSession, directory: str) -> DataFrame:
    """Every comment's text in the one form, with letter case folded."""
    return canonical.normalise_text(table(spark, directory, "comments")).distinct()


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Comments and chunks over 512 code points, and which of them have no white space to cut at."""
    parts = []
    for kind, name, key in (("comment", "comments", "source_id"), ("chunk", "chunks", "chunk_id")):
        pieces = splitting.split_items(table(spark, directory, name), id_col=key, only_oversized=True)
        case = F.explode(F.when(F.col("boundary") == splitting.CHARACTER, F.array(F.lit("oversized"), F.lit("unbreakable"))).otherwise(F.array(F.lit("oversized"))))
        parts.append(pieces.select(F.lit(kind).alias("item_kind"), F.col(key).alias("item_id"), case.alias("case_kind")))
    return parts[0].union(parts[1]).distinct()


def p4_comment_pieces(spark: SparkSession, directory: str) -> DataFrame:
    """The pieces of every comment."""
    return splitting.split_items(table(spark, directory, "comments").select("source_id", "text").distinct(), id_col="source_id")


def p4_whole_paragraphs(spark: SparkSession, directory: str) -> DataFrame:
    """The paragraphs of oversized comments that stand whole in a piece: all that fit the limit."""
    comments = table(spark, directory, "comments").select("source_id", "text").distinct()
    long = comments.where(F.length("text") > splitting.SplitRule().limit)
    parts = long.select("source_id", F.explode(F.split("text", BLANK_LINE)).alias("part"))
    wanted = parts.select("source_id", F.regexp_replace("part", EDGES, "").alias("paragraph")).where(~F.col("paragraph").rlike(MARKUP) & (F.length("paragraph").between(1, splitting.SplitRule().limit))).distinct()
    pieces = splitting.split_items(comments, id_col="source_id", only_oversized=True).select("source_id", "piece_text")
    return wanted.join(pieces, "source_id").where(F.col("piece_text").contains(F.col("paragraph"))).select("source_id", "paragraph").distinct()


def p4_chunk_pieces(spark: SparkSession, directory: str) -> DataFrame:
    """The pieces of every chunk, with the comments that each touches."""
    return splitting.split_chunks(table(spark, directory, "chunks"), table(spark, directory, "pseudo_spans"))


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    """Pairs of comments of at least 30 words whose three-word runs have a similarity of at least 0.7."""
    return near_duplicates.near_duplicate_pairs(table(spark, directory, "comments"))


def p5_groups(spark: SparkSession, directory: str) -> DataFrame:
    """The group of each comment of at least 30 words, and its links."""
    return near_duplicates.near_duplicate_groups(table(spark, directory, "comments"))


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    """Where personal information begins in the texts of comments, and its kind."""
    found = pii.find_personal_information(table(spark, directory, "comments"), table(spark, directory, "name_list"))
    return found.select("source_id", "pii_kind", "start_pos").distinct()


def p6_clean(spark: SparkSession, directory: str) -> DataFrame:
    """Every comment's text with typed placeholders."""
    return pii.replace_personal_information(table(spark, directory, "comments"), table(spark, directory, "name_list")).distinct()


def p7_ids(spark: SparkSession, directory: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.encode_corpus(table(spark, directory, "documents"))


def _mixture(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    sized = tokens.count_tokens(table(spark, directory, "documents"), keep=["doc_id", "source"])
    return mixing.mix_sources(sized, table(spark, directory, "mix_targets"))


def p8_selection(spark: SparkSession, directory: str) -> DataFrame:
    """The documents of the mixture, with how often each is used."""
    return _mixture(spark, directory)[0]


def p8_shares(spark: SparkSession, directory: str) -> DataFrame:
    """The share that each source reached in the mixture."""
    return _mixture(spark, directory)[1]


def _subjects(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    model = subjects.train_subjects(documents, table(spark, directory, "subjects"), table(spark, directory, "subject_examples"))
    return subjects.document_subjects(documents, model)


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    """The subjects of each document."""
    return _subjects(spark, directory).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, directory: str) -> DataFrame:
    """Documents by source and subject; those without subject count under null."""
    documents = table(spark, directory, "documents").select("doc_id", "source").distinct()
    found = _subjects(spark, directory).select("doc_id", "subject").distinct()
    return documents.join(found, "doc_id", "left").groupBy("source", "subject").agg(F.count("*").alias("documents"))


QUERIES = {
    "p2_found": p2_found,
    "p2_stretches": p2_stretches,
    "p3_found": p3_found,
    "p3_forms": p3_forms,
    "p4_found": p4_found,
    "p4_comment_pieces": p4_comment_pieces,
    "p4_whole_paragraphs": p4_whole_paragraphs,
    "p4_chunk_pieces": p4_chunk_pieces,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_clean": p6_clean,
    "p7_ids": p7_ids,
    "p8_selection": p8_selection,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}

_TEXTS = "SELECT DISTINCT 'comment' AS item_kind, source_id AS item_id, text FROM comments UNION SELECT 'chunk', chunk_id, text FROM chunks"
ORACLES: dict[str, str] = {
    "p4_found": f"""
        SELECT item_kind, item_id, unnest(CASE WHEN regexp_matches(text, '[^{SPACE[1:]}{{513}}')
               THEN ['oversized', 'unbreakable'] ELSE ['oversized'] END) AS case_kind
        FROM ({_TEXTS}) WHERE length(text) > 512""",
    "p4_whole_paragraphs": f"""
        SELECT DISTINCT source_id, paragraph FROM (
            SELECT source_id, regexp_replace(unnest(regexp_split_to_array(text, '{BLANK_LINE}')), '{EDGES}', '', 'g') AS paragraph
            FROM (SELECT DISTINCT source_id, text FROM comments WHERE length(text) > 512))
        WHERE length(paragraph) BETWEEN 1 AND 512 AND NOT regexp_matches(paragraph, '{MARKUP}')""",
}
