"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, language, media, minhash, packing, pieces, substrings, tokens, toxicity, urls
from .common import table


def _fold_number(folds: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.remove_repeated(table(spark, sf_dir, "documents"), window=50)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: The rules that decide before the method does.
URL_RULES = [urls.Rule(urls.ALLOW, "com/"), urls.Rule(urls.BLOCK, "example.com/en/"), urls.Rule(urls.ALLOW, "www.example.com/en/"), urls.Rule(urls.BLOCK, "net/es/"), urls.Rule(urls.BLOCK, "net/fr/")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge_urls(pages, URL_RULES, urls.fit_urls(pages, URL_RULES))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives the text again (a text's own U+2581 comes back as a space)."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), model), model)
    text = F.coalesce("text", F.lit(""))
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), (F.col("decoded") == F.translate(text, pieces.SPACE, " ")).alias("round_trip"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit_language(docs.where(_fold_number(3) != 1))
    return language.identify(docs, model).select("doc_id", F.coalesce(_fold_number(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images, so each vector is drawn as one: near-copies of vectors become edited copies of images."""
    return media.link_images(media.mosaics(table(spark, sf_dir, "embeddings")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels").where(_fold_number(4) != 2))
    return toxicity.score_toxicity(docs, model).select("doc_id", F.coalesce(_fold_number(4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=75)


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_packing": op5_packing,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_language_id": op7_language_id,
    "op8_media_copies": op8_media_copies,
    "op9_toxicity": op9_toxicity,
    "op10_minhash_dedup": op10_minhash_dedup,
}
#: Components by passing the smallest id along links, from a table linked(a, b) that holds both directions.
_COMPONENTS = "reach(a, b) as (select a, b from linked union select r.a, l.b from reach r join linked l on r.b = l.a), part as (select a, least(a, min(b)) c from reach group by a)"
#: Where SQL can say the whole result. The other operators' are tokens of a library, learned models, packings and images: tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op2_embedding_dedup": f"""with recursive v as (select vec_id, cast(embedding as double[]) e from embeddings where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
 linked as (select x.vec_id a, y.vec_id b from v x join v y on x.vec_id <> y.vec_id and len(x.e) = len(y.e) where list_dot_product(x.e, y.e) / sqrt(list_dot_product(x.e, x.e) * list_dot_product(y.e, y.e)) >= 0.9), {_COMPONENTS}
 select vec_id, (select count(*) from linked where a = vec_id) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept from embeddings left join part on a = vec_id""",
    "op3_substring_dedup": r"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
 h as (select doc_id, list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' '))) hs from d where len(w) >= 50),
 k as (select doc_id, unnest(hs) h, generate_subscripts(hs, 1) i from h),
 f as (select h, min(doc_id) m from k group by h),
 g as (select doc_id, list(distinct j) gone from (select k.doc_id, unnest(range(k.i, k.i + 50)) j from k join f using (h) where m < k.doc_id) group by doc_id)
 select d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(array_to_string(list_filter(w, lambda x, i: not list_contains(coalesce(gone, []), i)), ' ')) AS kept_sha256 from d left join g using (doc_id)""",
    "op10_minhash_dedup": rf"""with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
 s as (select doc_id, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: md5(array_to_string(w[i:i + 4], ' ')))) sh from d where len(w) > 0),
 n as (select doc_id, len(sh) n from s), t as (select doc_id, unnest(sh) x from s),
 pairs as (select p.doc_id a, q.doc_id b, count(*) k from t p join t q on p.x = q.x and p.doc_id <> q.doc_id group by all),
 linked as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)), {_COMPONENTS}
 select d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept from d left join n on n.doc_id = d.doc_id left join part on a = d.doc_id""",
}
