"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeseam.llm import lookalike, mix, neardup, neighbours, ocr, pack, qa_defects, split, tokens
from lodeseam.session import table


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "doc_index").select("id", "embedding", "embedding_valid")
    return neighbours.usable(rows, "embedding", 64, "embedding_valid").dropDuplicates(["id"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbours.nearest(_vectors(spark, d), "id", "embedding", least=0.9)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every hundredth id among all rows; noise needs a far wider search than near pairs."""
    return neighbours.nearest(_vectors(spark, d), "id", "embedding", miss=0.1, asks=F.col("id") % 100 == 0)


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    """The rows of doc_index whose content is too long, once per id, in pieces."""
    rows = table(spark, d, "doc_index").select("id", "page", "content").where(F.length("content") > split.LIMIT).dropDuplicates(["id"])
    return split.split_oversized(rows)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("piece_no = 0").select("id", F.col("piece_cut").alias("cut"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).select("id", "piece_no", "piece_start", "piece_page", "piece")


def _near(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of one document level, scanned pages aside, by runs of three words and a similarity of 0.6 (TESTDATA.md)."""
    rows = table(spark, d, "doc_index").where((F.col("level") == 1) & ~F.coalesce(F.lower("doc_type") == "pdf_ocr", F.lit(False)))
    return neardup.near_duplicates(rows.select("id", "content").dropDuplicates(["id"]), "id", "content", threshold=0.6, width=3, least_words=40)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.all_pairs(*_near(spark, d))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.duplicate_groups(*_near(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    # rows delivered twice have the same defect; only the few defective ones are compared
    return qa_defects.find_defects(table(spark, d, "synthetic_qa").select("id", "question", "answer")).distinct()


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "doc_index").select("id", "source", "page", "doc_type", "content")
    return ocr.repair_pages(rows.where(F.lower("doc_type") == "pdf_ocr"), rows)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).select("id", F.explode("kinds").alias("kind"))


def p7_text(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d).select("id", F.array_join("kinds", ",").alias("kinds"), "text")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack_documents(table(spark, d, "documents").select("doc_id", "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("piece_no > 0").select("doc_id").distinct()


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    used = _packed(spark, d).where("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return used.agg(
        F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.ceil(F.sum("n") / pack.CAPACITY).alias("least_containers"), F.round(F.sum("n") / (F.count("*") * pack.CAPACITY), 6).alias("fill")
    )


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "source", tokens.token_count(F.col("text")).alias("size"))
    return mix.plan_mixture(docs, table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[0].withColumnsRenamed({"key": "doc_id", "size": "n_tokens"})


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.mixture_shares(*_mixture(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return lookalike.look_alike_pairs(lookalike.look_alike_classes(docs)).select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p10_unified(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.unify_look_alikes(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "unified")


QUERIES = {f.__name__: f for f in (p2_found, p2_neighbours, p4_found, p4_pieces, p5_found, p5_groups, p6_found, p7_found, p7_text, p8_found, p8_containers, p8_fill, p9_mix, p9_shares, p10_found, p10_unified)}

_WS = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{85}]"
_E = r"[\n\r\x0b\x{85}\x{2028}\x{2029}]"


def _longest(pieces: str) -> str:
    return f"list_max(list_transform({pieces}, lambda x: length(regexp_replace(x, '^{_WS}+|{_WS}+$', '', 'g'))))"


def _looks(c: str) -> str:
    """One form of a text in plain functions: enough for spaces, unseen characters, full-width and joined letters, accents and the letters of SAME_SHAPE."""
    wide = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
    one = {k: v for k, v in (wide | lookalike.SAME_SHAPE).items()} | {"\u212b": "\u00c5", "\u212a": "K", "\u2126": "\u03a9"}
    # letters first: a Cyrillic letter and an accent would else be composed to a Cyrillic one
    to = "".join(one.values()).replace("'", "''")
    out = f"translate({c}, '{''.join(one)}', '{to}')"
    for joined in ("ffi", "ffl", "ff", "fi", "fl"):
        out = f"replace({out}, '{ {'ffi': chr(0xFB03), 'ffl': chr(0xFB04), 'ff': chr(0xFB00), 'fi': chr(0xFB01), 'fl': chr(0xFB02)}[joined] }', '{joined}')"
    out = rf"regexp_replace(regexp_replace({out}, '\p{{Zs}}', ' ', 'g'), '[\p{{Cf}}\x{{34F}}\x{{115F}}\x{{1160}}\x{{17B4}}\x{{17B5}}\x{{180B}}-\x{{180D}}\x{{3164}}\x{{FE00}}-\x{{FE0F}}\x{{FFA0}}]', '', 'g')"
    return f"nfc_normalize({out})"


SQL: dict[str, str] = {
    "p2_found": "with v as (select distinct on (id) id, embedding::double[] v from doc_index where embedding_valid and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0), "
    "p as (select a.id a, b.id b, round(list_cosine_similarity(a.v, b.v), 9) c from v a join v b on a.id <> b.id), n as (select *, row_number() over (partition by a order by c desc, b) r from p where c >= 0.9) "
    "select distinct least(a, b) id_a, greatest(a, b) id_b from n where r <= 5",
    "p10_found": f"with t as (select doc_id, text, {_looks('text')} l from documents where text is not null) select a.doc_id doc_id_a, b.doc_id doc_id_b from t a join t b on a.l = b.l and a.doc_id < b.doc_id and a.text <> b.text",
    "p4_found": f"with t as (select distinct id, replace(content, chr(13) || chr(10), chr(10)) c from doc_index where length(content) > 2048) select id, "
    + f"case when {_longest(f"regexp_split_to_array(c, '\\f|{_E}[ \\t]*{_E}')")} <= 2048 then 'paragraph' when {_longest(f"regexp_split_to_array(c, '\\f|{_E}')")} <= 2048 then 'line' "
    + f"when {_longest(f"regexp_split_to_array(regexp_replace(c, '([.!?]){_WS}', '\\1' || chr(1), 'g'), '\\f|{_E}|\\x01')")} <= 2048 then 'sentence' when {_longest(f"regexp_split_to_array(c, '{_WS}+')")} <= 2048 then 'word' else 'forced' end cut from t",
    "p5_found": r"with w as (select distinct id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') w from doc_index where level = 1 and lower(doc_type) is distinct from 'pdf_ocr'), "
    "s as (select distinct id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] s from (select id, w, unnest(range(1, len(w) - 1)) i from w where len(w) >= 40)), n as (select id, count(*) n from s group by 1), "
    "b as (select a.id id_a, b.id id_b, count(*) c from s a join s b on a.s = b.s and a.id < b.id group by 1, 2) select id_a, id_b from b join n x on x.id = id_a join n y on y.id = id_b where c / (x.n + y.n - c) >= 0.6",
}
