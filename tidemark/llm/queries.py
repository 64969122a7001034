"""One query per operator over the given tables, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact, graph, lexical, lines, minhash, mixing, pieces, preferences, quality, repeats, runs, secrets, topk
from tidemark.llm.text import WORD, id_of
from tidemark.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The model of the registered queries; the operators take any.
PIECE_MODEL = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_mixing_sources")
def op1(spark, sf):
    mixed = mixing.mix(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
    )


@query(
    "op2_preference_formatting",
    r"""with t as (select conv_id, list(struct_pack(role := role, text := text) order by turn, role, text) as turns from (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations) group by conv_id),
 a as (select *, len(turns) - list_position(list_reverse(list_transform(turns, lambda x: x.role)), 'assistant') + 1 as last,
  floor(coalesce(conv_id, -1) / 64) as stretch from t where list_contains(list_transform(turns, lambda x: x.role), 'assistant')),
 d as (select conv_id, turns[1:last] as c, turns, last, struct_pack(id := conv_id, answer := turns[last]) as me, stretch from a),
 e as (select *, coalesce(lead(me) over (partition by stretch order by conv_id nulls first),
  first_value(me) over (partition by stretch order by conv_id nulls first)) as donor from d),
 p as (select conv_id as pair_id, donor.id as donor_id, c, list_append(turns[1:last - 1], donor.answer) as r,
  case when turns[last] = donor.answer then last else last - 1 end as n from e),
 q as (select *, c[n + 1:] as cc, r[n + 1:] as rr from p),
 f as (select *, list_transform(c[1:n], lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)) as prompt_parts from q)
 select pair_id, donor_id, n::bigint as n_prompt_turns, coalesce(array_to_string(prompt_parts, ''), '') as prompt,
  coalesce(array_to_string(list_transform(cc, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), ''), '') as chosen,
  coalesce(array_to_string(list_transform(rr, lambda x: '<|' || x.role || '|>' || chr(10) || x.text || '<|end|>' || chr(10)), ''), '') as rejected,
  case when len(cc) = 0 then '' else '14:' || (14 + len(cc[1].text) + 7) end as chosen_loss,
  case when len(rr) = 0 then '' else '14:' || (14 + len(rr[1].text) + 7) end as rejected_loss, len(cc) = 0 as same from f""",
)
def op2(spark, sf):
    pairs = preferences.format_pairs(preferences.answer_swaps(table(spark, sf, "conversations")))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return pairs.withColumns({c: written(c) for c in ("chosen_loss", "rejected_loss")})


@query(
    "op3_exact_top_k",
    """with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
 s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0)
 select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s
 qualify rank <= 10""",
)
def op3(spark, sf):
    vectors = topk.integer_vectors(table(spark, sf, "embeddings"))
    hits = topk.top_k(vectors, vectors.where(F.col("key") % 100 == 0), 10)
    return hits.withColumnRenamed("row_id", "vec_id")


@query(
    "op4_line_dedup",
    f"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
 k as (select *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from l),
 f as (select key, max(doc_id) as keep from k where len(key) >= 40 group by key having count(distinct doc_id) >= 5),
 m as (select k.*, f.key is not null and k.doc_id <> f.keep as dropped from k left join f using (key))
 select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256 from m group by doc_id""",
)
def op4(spark, sf):
    kept = lines.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", _sha(F.col("text")).alias("kept_sha256"))


@query("op5_minhash_near_dedup")
def op5(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    found = minhash.near_duplicates(documents, width=3, percent=85)
    return found.select(
        id_of("key").alias("doc_id"), "n_shingles", id_of("component").alias("component_id"),
        (F.col("key") == F.col("component")).alias("kept"),
    )


@query("op6_quality_classifier")
def op6(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    scored = quality.score_marks(documents, table(spark, sf, "labels"))
    return scored.select("doc_id", "expected_grade", "tail", quality.keep_clean(scored).alias("kept"))


@query("op7_sentencepiece_round_trip")
def op7(spark, sf):
    import public_tokenizers

    with open(public_tokenizers.path(PIECE_MODEL), "rb") as file:
        model = file.read()
    return pieces.round_trip(table(spark, sf, "documents").select("doc_id", "text"), model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        _sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        _sha(F.col("decoded")).alias("decoded_sha256"),
    )


@query("op8_suffix_dedup")
def op8(spark, sf):
    kept = repeats.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", _sha(F.col("kept")).alias("kept_sha256"))


@query("op9_secret_scan")
def op9(spark, sf):
    found = secrets.scan(table(spark, sf, "documents").select("doc_id", "text")).drop("text")
    base = [rule.kind for rule in secrets.BASE_RULES]
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", *[F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in base],
        _sha(written(of(*base))).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )


@query(
    "op10_exact_dedup",
    f"""with d as (select doc_id, {_LOWER.format("coalesce(text, '')")} as t from documents)
 select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from d""",
)
def op10(spark, sf):
    # Ids that are even stand for what earlier crawls have brought, the others for what arrives.
    documents = table(spark, sf, "documents").select("doc_id", "text")
    old = F.coalesce(F.col("doc_id") % 2 == 0, F.lit(False))
    rows = exact.dedup(documents.where(old), documents.where(~old))
    return rows.select(
        id_of("key").alias("doc_id"), id_of("keep_key").alias("keep_id"), "group_size", "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


@query("op11_nearest_neighbours")
def op11(spark, sf):
    vectors = graph.usable_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    hits = graph.search(graph.build_index(vectors), vectors, vectors.where(F.col("key") % 20 == 0), 20)
    return hits.withColumnRenamed("row_id", "vec_id")


def with_cycles(documents: DataFrame) -> DataFrame:
    """``documents`` (doc_id, text), where one in ten by crc32 of the id repeats a stretch of its words to its end.

    Such a text becomes its words joined by blanks. A null id names no document of these.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = documents.withColumns(
        {"h": h, "words": F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))}
    ).withColumns({"n": F.size("words").cast("long"), "g": F.floor(F.col("h") / 10)})
    cut = words.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    cut = cut.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    period = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    cycled = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), F.flatten(F.array_repeat(period, times))), F.lit(1), F.col("n").cast("int"))
    return cut.select("doc_id", F.when(F.col("n") > 0, F.array_join(cycled, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark, sf):
    found = runs.periodic_runs(with_cycles(table(spark, sf, "documents").select("doc_id", "text")))
    # The greatest length, then the smallest start, then the smallest period.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("below"))))
    written = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top")["before"]).alias("start"), F.col("top")["length"].alias("length"),
        (-F.col("top")["below"]).alias("period"), F.floor(1000 * F.col("top")["length"] / -F.col("top")["below"]).alias("exponent_milli"),
        _sha(written).alias("runs_sha256"), _sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    "op13_ranked_search",
    f"""with d as (select doc_id, {_TERMS} as terms from documents), kept as (select * from d where len(terms) > 0),
 c as (select count(*) as n, sum(len(terms))::bigint as words from kept),
 tf as (select doc_id, len(terms) as length, term, count(*) as tf from (select doc_id, terms, unnest(terms) as term from kept) group by all),
 q as (select item_id, term, count(*) as times from (select item_id, unnest({_TERMS}) as term from benchmark) group by all),
 w as (select term, floor(1000 * ln((2 * c.n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, c
  where term in (select term from q) group by term, c.n),
 s as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * length * c.n) // c.words))))::bigint as score
  from q join w using (term) join tf using (term), c group by all)
 select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from s where score > 0
 qualify rank <= 10""",
)
def op13(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return lexical.ranked_search(documents, table(spark, sf, "benchmark").select("item_id", "text"), 10)
