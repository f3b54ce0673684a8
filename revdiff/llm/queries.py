"""Registered queries of this subpackage: each applies one operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revdiff.llm import caps, collocation, decontaminate, langid, mixing, quality, sanitise, simhash, suffixtree, tokens, urlfilter, warc, whiten
from revdiff.llm.common import WORD, held_out
from revdiff.staging import stage


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = held_out(F.col("doc_id"), 10, 0)
    scored = suffixtree.score(docs, ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.dedupe(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stage(table(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_count("text", F.lit(WORD)).alias("n"), F.monotonically_increasing_id().alias("r")))
    mixed = mixing.copies(docs, row="r", size=F.col("n"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive_path(spark)
    warc.write(table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(stage(warc.read(spark, path, payloads=False)))
    kind = F.col("response.kind")
    return captures.select(
        F.col("page").cast("long").alias("page_id"), F.coalesce("metadata.payload_bytes", "response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), kind.alias("record_type"), F.when(kind == "revisit", F.col("refers_to")).alias("refers_to"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, ~held_out(F.col("doc_id"), 5, 0))
    return quality.score(docs, model).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, ~held_out(F.col("doc_id"), 3, 1))
    return langid.identify(docs, model).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score", "margin", "accepted")


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.neighbours(table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.components(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.mine(table(spark, sf_dir, "documents")).drop("words")


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_suffix_tree, op3_simhash, op4_mixing, op5_urls, op6_warc, op7_quality, op8_token_counts, op9_language, op10_vectors,
                                  op11_whitening, op12_collocations, op13_pii)}

#: DuckDB SQL for the rows of a query.
SQL: dict[str, str] = {
    "op6_warc": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
        g as (select d, max(page_id) as top, count(*) as c from p where n >= 1000 group by d)
        select p.page_id, p.n::bigint as payload_bytes, p.d as payload_digest,
               case when g.c > 1 and p.page_id <> g.top then 'revisit' else 'response' end as record_type,
               case when g.c > 1 and p.page_id <> g.top then g.top end as refers_to
        from p left join g using (d)""",
    "op12_collocations": r"""
        with piece as (
            select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[.,;:!?\x0A-\x0D]')) as p from documents),
        line as (select lang, regexp_extract_all(p, '[^\x20\x09]+') as w from piece),
        total as (select lang, sum(len(w))::bigint as n from line group by lang),
        word as (select lang, row_number() over () as line, w from line),
        place as (select lang, line, w, unnest(range(1, len(w) + 1)) as i from word),
        f as (
            select lang, w[i] as phrase, 1 as size, '' as head, '' as tail, '' as head2, '' as tail2, count(*)::bigint as f from place group by all having count(*) >= 10
            union all
            select lang, w[i] || ' ' || w[i + 1], 2, w[i], w[i + 1], '', '', count(*) from place where i < len(w) group by all having count(*) >= 10
            union all
            select lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], 3, w[i], w[i + 1] || ' ' || w[i + 2], w[i] || ' ' || w[i + 1], w[i + 2], count(*)
            from place where i + 1 < len(w) group by all having count(*) >= 10),
        split as (
            select lang, phrase, f as a, 1 as k, head, tail from f where size > 1
            union all select lang, phrase, f, 2, head2, tail2 from f where size = 3),
        cut as (
            select s.*, l.f as l, r.f as r, (1000000::hugeint * a * a) // (l.f::hugeint * r.f) as score
            from split s join f l on l.lang = s.lang and l.phrase = s.head join f r on r.lang = s.lang and r.phrase = s.tail),
        best as (select * from cut qualify row_number() over (partition by lang, phrase order by score, k) = 1),
        part as (select lang, head2 as phrase, f from f where size = 3 union all select lang, tail, f from f where size = 3),
        longer as (select lang, phrase, max(f) as f from part group by all),
        kept as (
            select b.* from best b left join longer o on o.lang = b.lang and o.phrase = b.phrase
            where o.f is null or 100 * o.f < 50 * b.a)
        select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score::bigint as score
        from kept join total using (lang) qualify rank <= 2000""",
}
