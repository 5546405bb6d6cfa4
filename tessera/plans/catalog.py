"""A query for each operator over the test tables and, where SQL expresses it, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import similarity as sim
from tessera.functions import text
from tessera.operators import blocking, candidates, decide, exports, features, knn, labels, metrics, reports, sampling, validate, windows
from tessera.operators.keys import CAND, PAIR, S1
from tessera.sources import sinks
from tessera.sources.stages import delete, staged

from . import models, views
from .views import EDGE, SEP, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Limits of blocking: the operator's own.
MAX_DF, KEYS, TOP_K = blocking.MAX_DF, blocking.KEYS, blocking.TOP_K


def query(name: str, oracle: str | None = None):
    """Registers a query; long column names become s1 and cand."""

    def keep(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumnsRenamed({S1: "s1", CAND: "cand"})

        QUERIES[name] = run
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return keep


def r6(c) -> F.col:
    return F.round(c, 6)


def joined(c):
    return F.array_join(c, "|")


# ---- text -------------------------------------------------------------------------------------------------------------

_TLD = "|".join(text.TOP_LEVEL_DOMAINS)


@query(
    "clean_names",
    rf"""select page_id, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '\bwww\.', '', 'g'),
        '([a-z0-9])\.({_TLD})\b', '\1', 'g'), '\s+', ' ', 'g')), '^{EDGE}', '') as name from pages""",
)
def _(spark, d):
    return views.table(spark, d, "pages").select("page_id", text.name_text(F.col("url")).alias("name"))


@query("tokenize", sql(f"select entity_id, array_to_string(list_filter(regexp_split_to_array(name, '{SEP}'), lambda t: t <> ''), '|') as tokens from rec", "rec"))
def _(spark, d):
    return views.rec(spark, d).select("entity_id", joined(text.tokenize(F.col("name"))).alias("tokens"))


_SUFFIXES = text.LEGAL_SUFFIXES | {"standard": "std", "small": "sm", "medium": "med", "anodized": "anod"}
_MAP = "map([" + ", ".join(f"'{k}'" for k in _SUFFIXES) + "], [" + ", ".join(f"'{v}'" for v in _SUFFIXES.values()) + "])"


@query("canon_suffix", f"select p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda t: coalesce({_MAP}[t], t)), '|') as tokens from part")
def _(spark, d):
    return views.table(spark, d, "part").select("p_partkey", joined(text.canonical_suffixes(text.tokenize(F.lower("p_type")), _SUFFIXES)).alias("tokens"))


@query("digit_tokens", sql(rf"select entity_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(coalesce(address, ''), '{SEP}'), lambda t: regexp_full_match(t, '[0-9]+')))), '|') as digits from addr", "addr"))
def _(spark, d):
    return views.addr(spark, d).select("entity_id", joined(text.digit_tokens(text.tokenize(F.col("address")))).alias("digits"))


@query("stopword_filter", sql(f"select entity_id, array_to_string(list_filter(list_filter(regexp_split_to_array(lower(name), '{SEP}'), lambda t: t <> ''), lambda t: not list_contains(['the', 'of', 'and', 'de', 'der'], t)), '|') as tokens from rec", "rec"))
def _(spark, d):
    return views.rec(spark, d).select("entity_id", joined(text.without(text.tokenize(F.lower("name")), ["the", "of", "and", "de", "der"])).alias("tokens"))


@query(
    "parse_address",
    sql(
        rf"""select entity_id, len(c) > 0 as present, address as normalized, c[1] as head, c[len(c)] as tail, case when len(c) > 2 then array_to_string(c[2:len(c)-1], '|') else '' end as middle
        from (select entity_id, coalesce(address, '') as address, list_filter(list_transform(string_split(coalesce(address, ''), ','), lambda x: regexp_replace(x, '^{EDGE}|{EDGE}$', '', 'g')), lambda x: x <> '') as c from addr)""",
        "addr",
    ),
)
def _(spark, d):
    a = views.addr(spark, d).select("entity_id", text.address_struct(F.col("address")).alias("a"))
    return a.select("entity_id", "a.present", "a.normalized", "a.head", "a.tail", joined(F.col("a.middle")).alias("middle"))


_DROP = "[" + ", ".join(f"'{w}'" for w in sorted({*text.STREET_TYPES, *text.STREET_FILLERS})) + "]"
_TYPES = "[" + ", ".join(f"'{w}'" for w in text.STREET_TYPES) + "]"


@query(
    "street_core",
    sql(
        rf"""select entity_id, array_to_string(list_filter(coalesce(list_filter(c, lambda t: list_has_any(t, {_TYPES}))[1], list_filter(c, lambda t: len(list_filter(t, lambda w: regexp_matches(w, '[0-9]'))) > 0)[1], []),
            lambda w: length(w) > 1 and not list_contains({_DROP}, w) and not regexp_full_match(w, '[0-9]+[a-z]?')), ' ') as street
        from (select entity_id, list_transform(string_split(coalesce(address, ''), ','), lambda x: list_filter(regexp_split_to_array(x, '{SEP}'), lambda t: t <> '')) as c from addr)""",
        "addr",
    ),
)
def _(spark, d):
    return views.addr(spark, d).select("entity_id", text.street_core(F.col("address")).alias("street"))


_SKIP = "[" + ", ".join(f"'{w}'" for w in sorted({*text.STOPWORDS, *text.FURTHER_LEGAL_FORMS})) + "]"


@query(
    "initials",
    sql(
        f"""select entity_id, array_to_string(list_transform(t, lambda w: substring(w, 1, 1)), '') as initials, array_to_string(t, '') as compact
        from (select entity_id, list_filter(list_filter(regexp_split_to_array(lower(name), '{SEP}'), lambda t: t <> ''), lambda t: not list_contains({_SKIP}, t)) as t from rec)""",
        "rec",
    ),
)
def _(spark, d):
    t = text.tokenize(F.lower("name"))
    return views.rec(spark, d).select("entity_id", text.initials(t).alias("initials"), text.compact(t).alias("compact"))


@query("record_text", sql("select entity_id, case when coalesce(address, '') = '' then name else name || ', ' || address end as record_text from addr", "addr"))
def _(spark, d):
    return views.addr(spark, d).select("entity_id", text.record_text(F.col("name"), F.col("address")).alias("record_text"))


_FOLDED = r"trim(regexp_replace(regexp_replace(strip_accents(name), '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g'))"


@query("len_script", sql(rf"select entity_id, length(name) as name_len, round(greatest(0, least(1, 1 - length(folded)::double / nullif(length(name), 0))), 6) as nonascii from (select entity_id, name, {_FOLDED} as folded from rec)", "rec"))
def _(spark, d):
    n = F.col("name")
    return views.rec(spark, d).select("entity_id", F.char_length(n).cast("long").alias("name_len"), r6(text.nonascii_share(n, text.ascii_fold(n))).alias("nonascii"))


@query("nfkc_fold", sql(f"select entity_id, lower(name) as lowered, case when regexp_full_match(name, '[\\x00-\\x7F]*') then trim(regexp_replace(name, '\\s+', ' ', 'g')) else {_FOLDED} end as folded from rec", "rec"))
def _(spark, d):
    return views.rec(spark, d).select("entity_id", text.lower_nfkc(F.col("name")).alias("lowered"), text.ascii_fold(F.col("name")).alias("folded"))


@query(
    "char3",
    """select c_custkey, array_to_string(list_sort(list_distinct(flatten(list_transform(list_filter(string_split(lower(c_name || ' ' || c_mktsegment), ' '), lambda w: w <> ''),
        lambda w: list_transform(range(1, greatest(length(w), 1)::bigint + 1), lambda i: substring(' ' || w || ' ', i, 3)))))), '|') as grams from customer""",
)
def _(spark, d):
    t = F.lower(F.concat_ws(" ", "c_name", "c_mktsegment"))
    return views.table(spark, d, "customer").select("c_custkey", joined(F.array_sort(text.trigrams(t))).alias("grams"))


@query("clean_records", sql(
    rf"""select entity_id, country, n as name_original_normalized, array_to_string(list_filter(regexp_split_to_array(n, '{SEP}'), lambda t: t <> ''), '|') as tokens, a as address_normalized
    from (select entity_id, country, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(name)), '\bwww\.', '', 'g'), '([a-z0-9])\.({_TLD})\b', '\1', 'g'), '\s+', ' ', 'g')), '^{EDGE}', '') as n,
      trim(regexp_replace(lower(coalesce(address, '')), '\s+', ' ', 'g')) as a from addr)""", "addr"))
def _(spark, d):
    c = text.clean_records(views.addr(spark, d), name="name", address="address")
    return c.select("entity_id", "country", "name_original_normalized", joined(F.col("name_tokens")).alias("tokens"), "address_normalized")


@query("street_component", sql(
    r"""select entity_id, coalesce(x.i, 0)::int - 1 as index, coalesce(trim(x.c), '') as component, coalesce(x.n, '') as number from (
    select entity_id, list_filter(list_transform(range(1, len(p) + 1), lambda i: {'i': i, 'c': p[i], 'n': list_filter(regexp_split_to_array(trim(p[i]), '\s+'), lambda t: regexp_full_match(t, '[0-9]+'))[1]}), lambda s: s.n is not null)[1] as x
    from (select entity_id, string_split(coalesce(address, ''), ',') as p from addr))""", "addr"))
def _(spark, d):
    return views.addr(spark, d).select("entity_id", text.street_component(F.col("address")).alias("x")).select("entity_id", "x.*")


@query("logit_blend", sql("""select s1, cand, round(1 / (1 + exp(-(0.806 * ln(p / (1 - p)) + 0.184 * ln(q / (1 - q)) - 0.275))), 6) as blended
    from (select s1, cand, greatest(least(score, 1 - 1e-6), 1e-6) as p, greatest(least(ce, 1 - 1e-6), 1e-6) as q from pairs)""", "pairs"))
def _(spark, d):
    return views.pairs(spark, d).select(*PAIR, r6(decide.blend(F.col("score"), F.col("ce"), 0.806, 0.184, -0.275)).alias("blended"))


# ---- blocking ---------------------------------------------------------------------------------------------------------


def _selected(spark, d):
    r = views.keyed_rec(spark, d)
    return views.sides(r), blocking.select_keys(*views.sides(r), max_df=MAX_DF, keys=KEYS)


def _candidates(spark, d):
    return blocking.token_blocking(*views.sides(views.keyed_rec(spark, d)), max_df=MAX_DF, keys=KEYS, k=TOP_K)


def _same(spark, d):
    """True pairs of rec: equal name and address in one country."""
    a, b = views.sides(views.rec(spark, d))
    b = b.select(F.col("entity_id").alias("matched_id"), "country", "name", "address")
    return a.withColumnRenamed("entity_id", S1).join(b, ["country", "name", "address"]).select(S1, "matched_id", "country")


@query("doc_freq", sql("select country, side, token, df from dfs", "dfs"))
def _(spark, d):
    return blocking.document_frequency(blocking.record_keys(views.sides(views.keyed_rec(spark, d))[1]))


@query("idf", sql("select country, side, token, df, n_docs, round(idf, 6) as idf from idfs", "idfs"))
def _(spark, d):
    t = views.sides(views.keyed_rec(spark, d))[1]
    return blocking.idf(blocking.document_frequency(blocking.record_keys(t)), blocking.country_sizes(t)).withColumn("idf", r6("idf"))


@query("smoothed_idf", sql("""select country, token, round(ln((n + 1) / (df + 1)) + 1, 6) as idf from (select country, token, count(distinct id) as df from keys where side = 'address' group by all)
    join (select country, count(*) as n from rec group by country) using (country)""", "keys"))
def _(spark, d):
    r = views.keyed_rec(spark, d)
    rows = r.select("country", F.explode(F.array_distinct(text.tokenize(F.col("address_normalized")))).alias("token"))
    return features.smoothed_idf(rows, r.groupBy("country").agg(F.count("*").alias("n_docs"))).withColumn("idf", r6("idf"))


@query("token_stats", sql("""select entity_id, count(*)::int as size, round(sum(idf), 6) as idf_sum, round(sqrt(sum(idf * idf)), 6) as idf_norm from (
    select id as entity_id, ln((n + 1) / (df + 1)) + 1 as idf from keys join (select country, token, count(distinct id) as df from keys where side = 'address' group by all) using (country, token)
    join (select country, count(*) as n from rec group by country) using (country) where side = 'address') group by entity_id""", "keys"))
def _(spark, d):
    r = views.keyed_rec(spark, d).withColumn("t", text.tokenize(F.col("address_normalized")))
    w = features.token_weights(r, "t", "w").select("entity_id", features.token_stats(F.col("w")).alias("s"))
    return w.select("entity_id", "s.size", r6("s.idf_sum").alias("idf_sum"), r6("s.idf_norm").alias("idf_norm"))


@query("rare_keys", sql("select id, country, side, token, df, round(idf, 6) as idf from rare", "rare"))
def _(spark, d):
    return _selected(spark, d)[1][0].withColumn("idf", r6("idf"))


@query("pair_scores", sql("select s1, cand, country, round(score, 6) as score from scored", "scored"))
def _(spark, d):
    return blocking.pair_scores(*_selected(spark, d)[1]).withColumn("score", r6("score"))


@query("token_blocking", sql("select s1, cand, round(score, 6) as score, country from cands", "cands"))
def _(spark, d):
    return _candidates(spark, d).withColumn("score", r6("score"))


@query("topk", sql("select s1, cand, score from (select *, row_number() over (partition by s1 order by score desc, cand) as r from pairs) where r <= 2", "pairs"))
def _(spark, d):
    return blocking.top_k(views.pairs(spark, d), 2).select(*PAIR, "score")


@query("recall_ceiling", sql("""select distinct tp.s1, tp.matched_id from tp join rare r on r.id = tp.s1 join keys k on k.id = tp.matched_id and k.country = r.country and k.side = r.side and k.token = r.token""", "tp", "rare"))
def _(spark, d):
    _, (selected, keys) = _selected(spark, d)
    return blocking.recall_ceiling(_same(spark, d).select(S1, "matched_id"), selected, keys)


@query("blocking_diag", sql("""select q.country, n_query, n_target, coalesce(n, 0) as n_candidate_pairs, round(coalesce(n, 0) / n_query, 6) as avg_candidates_per_entity,
      round(1 - coalesce(n, 0) / (n_query * n_target), 6) as reduction_ratio, n_gt_pairs, round(recall_ceiling, 6) as recall_ceiling, round(recall_at_k, 6) as recall_at_k
    from (select country, count(*) as n_query from rec where side = 'S1' group by 1) q join (select country, count(*) as n_target from rec where side <> 'S1' group by 1) t on q.country = t.country
    left join (select country, count(*) as n from cands group by 1) c on c.country = q.country
    left join (select r.country, count(*) as n_gt_pairs, count(x.s1) / count(*) as recall_ceiling, count(c.s1) / count(*) as recall_at_k from tp join rec r on r.entity_id = tp.s1
      left join (select distinct tp.s1, tp.matched_id from tp join rare r on r.id = tp.s1 join keys k on k.id = tp.matched_id and k.country = r.country and k.side = r.side and k.token = r.token) x on x.s1 = tp.s1 and x.matched_id = tp.matched_id
      left join cands c on c.s1 = tp.s1 and c.cand = tp.matched_id group by 1) g on g.country = q.country""", "tp", "cands"))
def _(spark, d):
    (a, b), (selected, keys) = _selected(spark, d)
    selected, keys = staged(selected, "selected"), staged(keys, "keys")  # read by the candidates and by the ceiling
    found = staged(blocking.top_k(blocking.pair_scores(selected, keys), TOP_K), "candidates")
    t = _same(spark, d).select(S1, "matched_id")
    out = blocking.diagnostics(a, b, found, t, blocking.recall_ceiling(t, selected, keys))
    return out.withColumns({c: r6(c) for c in ("avg_candidates_per_entity", "reduction_ratio", "recall_ceiling", "recall_at_k")})


# ---- vectors ----------------------------------------------------------------------------------------------------------


@query("row_cosine", sql("select a.id as s1, b.id as cand, round(list_dot_product(a.embedding, b.embedding), 6) as cosine from vec a join vec b on b.id = a.id + 1", "vec"))
def _(spark, d):
    v = views.vec(spark, d)
    p = v.select(F.col("id").alias(S1), (F.col("id") + 1).alias(CAND)).join(v.select(F.col("id").alias(CAND)), CAND, "left_semi")
    return candidates.with_cosine(p, v, name="cosine").withColumn("cosine", r6("cosine"))


_KNN = sql("select s1, cand, country, round(emb_score, 6) as emb_score, emb_rank from knn", "knn")


@query("knn", _KNN)
def _(spark, d):
    return knn.knn_pairs(views.vec(spark, d), 3).withColumn("emb_score", r6("emb_score"))


@query("knn_blocks", _KNN)
def _(spark, d):
    return knn.knn_blocks(views.vec(spark, d), 3).withColumn("emb_score", r6("emb_score"))


_TOKENS = "(select s1, cand, country, score from (select q.id as s1, t.id as cand, q.country, (q.id * 31 + t.id) % 997 / 997::double as score, row_number() over (partition by q.id order by (q.id * 31 + t.id) % 997 desc, t.id) as r from vec q join vec t on q.country = t.country and q.is_source1 and not t.is_source1) where r <= 4)"


def _token_like(spark, d):
    """Candidates of the vectors' records from another source of evidence."""
    v = views.vec(spark, d)
    q = v.filter("is_source1").select(F.col("id").alias(S1), "country")
    t = v.filter("not is_source1").select(F.col("id").alias(CAND), "country")
    return blocking.top_k(q.join(t, "country").withColumn("score", (F.col(S1) * 31 + F.col(CAND)) % 997 / 997.0), 4)


@query("candidate_union", sql(f"select coalesce(t.s1, e.s1) as s1, coalesce(t.cand, e.cand) as cand, coalesce(t.country, e.country) as country, round(coalesce(score, 0), 6) as score, round(emb_score, 6) as emb_score, emb_rank from {_TOKENS} t full join knn e on t.s1 = e.s1 and t.cand = e.cand", "knn"))
def _(spark, d):
    u = candidates.candidate_union(_token_like(spark, d), knn.knn_blocks(views.vec(spark, d), 3))
    return u.withColumns({"score": r6("score"), "emb_score": r6("emb_score")})


@query("retrieval_recall", sql(f"""select coalesce(country, 'ALL') as country, coalesce(script, 'ALL') as script, count(*) as true_pairs, round(avg((t is not null)::int), 6) as token_at_4,
    round(avg(coalesce(r < 1, false)::int), 6) as emb_at_1, round(avg((coalesce(r < 1, false) or t is not null)::int), 6) as union_at_1, round(avg(coalesce(r < 3, false)::int), 6) as emb_at_3, round(avg((coalesce(r < 3, false) or t is not null)::int), 6) as union_at_3
    from (select p.*, x.s1 as t, e.emb_rank as r from (select q.id as s1, t.id as m, q.country, case when q.id % 2 = 0 then 'latin' else 'other' end as script from vec q join vec t on q.country = t.country and q.is_source1 and not t.is_source1 where (q.id + t.id) % 10 = 1) p
      left join {_TOKENS} x on x.s1 = p.s1 and x.cand = p.m left join knn e on e.s1 = p.s1 and e.cand = p.m) group by grouping sets ((country, script), ())""", "knn"))
def _(spark, d):
    v = views.vec(spark, d)
    q = v.filter("is_source1").select(F.col("id").alias(S1), "country", F.when(F.col("id") % 2 == 0, "latin").otherwise("other").alias("script"))
    t = q.join(v.filter("not is_source1").select(F.col("id").alias("matched_id"), "country"), "country").filter((F.col(S1) + F.col("matched_id")) % 10 == 1)
    out = knn.recall_report(t, _token_like(spark, d), knn.knn_blocks(v, 3), ks=(1, 3), token_k=4)
    return out.withColumns({c: r6(c) for c in out.columns if "_at_" in c})


@query("distinct_scatter", sql("select entity_id, length(name) + 1 as n from rec", "rec"))
def _(spark, d):
    r = knn.encode(views.rec(spark, d), "name", lambda texts: [[float(len(t))] for t in texts], prefix="x")
    return r.select("entity_id", F.get("embedding", F.lit(0)).cast("long").alias("n"))


@query("candidate_counts", sql("select round(avg(n), 6) as mean_candidates, max(n) as max_candidates from (select s1, count(*) as n from pairs group by s1)", "pairs"))
def _(spark, d):
    return candidates.candidate_counts(views.pairs(spark, d)).withColumn("mean_candidates", r6("mean_candidates"))


@query("coherence", sql("""select s1, cand, p.country, partner, round(list_dot_product(a.embedding, b.embedding), 6) as coh_cos, case when partner is not null then (substring(cand::varchar, 1, 2) <> substring(partner::varchar, 1, 2))::int::double end as coh_other_source
    from (select *, case when row_number() over w = 1 then nth_value(cand, 2) over (w rows between unbounded preceding and unbounded following) else first_value(cand) over (w rows between unbounded preceding and unbounded following) end as partner from knn window w as (partition by s1 order by emb_score desc, cand)) p
    left join vec a on a.id = p.cand left join vec b on b.id = p.partner""", "knn"))
def _(spark, d):
    k = knn.knn_blocks(views.vec(spark, d), 3)
    out = windows.coherence(k, views.vec(spark, d), "emb_score", source=lambda c: text.source_of(c.cast("string")))
    return out.select(*PAIR, "country", "partner", r6("coh_cos").alias("coh_cos"), "coh_other_source")


# ---- similarities -----------------------------------------------------------------------------------------------------

_TOK = lambda c: f"list_distinct(list_filter(regexp_split_to_array(coalesce({c}, ''), '{SEP}'), lambda t: t <> ''))"


@query("set_sims", sql(f"""select s1, cand, round(i / nullif(na + nb - i, 0), 6) as jaccard, round(2 * i / nullif(na + nb, 0), 6) as dice from (
    select s1, cand, len(list_intersect(x, y))::double as i, len(x) as na, len(y) as nb from (select s1, cand, {_TOK('a')} as x, {_TOK('b')} as y from addr_pairs))""", "addr_pairs"))
def _(spark, d):
    a, b = (F.array_distinct(text.tokenize(F.col(c))) for c in "ab")
    return views.addr_pairs(spark, d).select(*PAIR, r6(sim.jaccard(a, b)).alias("jaccard"), r6(sim.dice(a, b)).alias("dice"))


@query("idf_sims", sql(f"""select s1, cand, round(list_sum(list_transform(list_intersect(x, y), lambda k: length(k) * length(k))) / nullif(sqrt(list_sum(list_transform(x, lambda k: length(k) * length(k)))) * sqrt(list_sum(list_transform(y, lambda k: length(k) * length(k)))), 0), 6) as cosine,
    round(coalesce(list_sum(list_transform(list_intersect(x, y), lambda k: length(k))), 0) / nullif(list_sum(list_transform(x, lambda k: length(k))), 0), 6) as containment
    from (select s1, cand, {_TOK('a')} as x, {_TOK('b')} as y from addr_pairs) where len(x) > 0 and len(y) > 0""", "addr_pairs"))
def _(spark, d):
    weights = lambda c: (t := F.array_distinct(text.tokenize(F.col(c))), F.map_from_arrays(t, F.transform(t, lambda w: F.char_length(w).cast("double"))))[1]
    p = views.addr_pairs(spark, d).filter("a is not null and b is not null").select(*PAIR, weights("a").alias("x"), weights("b").alias("y"))
    return p.select(*PAIR, r6(sim.idf_cosine(F.col("x"), F.col("y"))).alias("cosine"), r6(sim.idf_containment(F.col("x"), F.col("y"))).alias("containment"))


@query("digit_sims", sql(f"""select s1, cand, (len(list_intersect(x, y)) > 0)::int::double as digit_match, (len(x) > 0 and len(y) > 0 and len(list_intersect(x, y)) = 0)::int::double as digit_conflict,
    round(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 6) as digit_jaccard
    from (select s1, cand, list_filter({_TOK('a')}, lambda t: regexp_full_match(t, '[0-9]+')) as x, list_filter({_TOK('b')}, lambda t: regexp_full_match(t, '[0-9]+')) as y from addr_pairs)""", "addr_pairs"))
def _(spark, d):
    a, b = (text.digit_tokens(text.tokenize(F.col(c))) for c in "ab")
    return views.addr_pairs(spark, d).select(*PAIR, sim.digit_match(a, b).alias("digit_match"), sim.digit_conflict(a, b).alias("digit_conflict"), r6(sim.jaccard(a, b)).alias("digit_jaccard"))


@query("len_ratio", sql("select s1, cand, round(least(length(a), length(b))::double / nullif(greatest(length(a), length(b)), 0), 6) as len_ratio from addr_pairs where a is not null and b is not null", "addr_pairs"))
def _(spark, d):
    p = views.addr_pairs(spark, d).filter("a is not null and b is not null")
    return p.select(*PAIR, r6(sim.length_ratio(F.char_length("a"), F.char_length("b"))).alias("len_ratio"))


@query("acronym", "select p_partkey, (length(i) >= 2 and i = lower(substring(p_brand, 1, 2)))::int::double as acronym from (select *, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: substring(w, 1, 1)), '') as i from part)")
def _(spark, d):
    i = F.array_join(F.transform(F.split(F.lower("p_name"), " "), lambda w: F.substring(w, 1, 1)), "")
    one = sim.acronym_match(i, F.lit(""), F.lit("-"), F.lower(F.substring("p_brand", 1, 2)))
    return views.table(spark, d, "part").select("p_partkey", one.alias("acronym"))


def _names(spark, d):
    p = views.table(spark, d, "part").select("p_partkey", "p_name")
    return p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey")


_NAMES = "(select a.p_partkey, a.p_name, b.p_name as other from part a join part b on b.p_partkey = a.p_partkey + 1)"


@query("jaro_winkler", f"select p_partkey, round(jaro_winkler_similarity(p_name, other), 6) as similarity from {_NAMES}")
def _(spark, d):
    return _names(spark, d).select("p_partkey", r6(sim.winkler("p_name", "other")).alias("similarity"))


@query("indel_ratio", f"""with recursive n as (select * from {_NAMES}),
    dp as (select p_partkey, p_name, other, 0 as i, list_transform(range(length(other) + 1), lambda x: 0) as row from n
      union all select p_partkey, p_name, other, i + 1, list_reduce(list_transform(range(0, length(other)), lambda j: {{'v': [0], 'j': j}}), lambda s, x: {{'v': list_append(s.v, case when substring(p_name, i + 1, 1) = substring(other, (x.j + 1)::int, 1)
          then row[x.j + 1] + 1 else greatest(s.v[len(s.v)], row[x.j + 2]) end), 'j': x.j}}, {{'v': [0], 'j': 0::bigint}}).v from dp where i < length(p_name))
    select p_partkey, round(2 * row[len(row)] / (length(p_name) + length(other)), 6) as similarity from dp where i = length(p_name)""")
def _(spark, d):
    return _names(spark, d).select("p_partkey", r6(sim.ratio("p_name", "other")).alias("similarity"))


@query("text_sims")
def _(spark, d):
    p = _names(spark, d)
    return p.select("p_partkey", r6(sim.partial("p_name", "other")).alias("partial"), r6(sim.token_sort("p_name", "other")).alias("token_sort"), r6(sim.token_set("p_name", "other")).alias("token_set"))


# ---- windows ----------------------------------------------------------------------------------------------------------


@query("context_features", sql("""select s1, cand, block_rank, round(score / nullif(m, 0), 6) as block_score_rel, n_candidates, round(max(ce) over (partition by s1) - ce, 6) as ce_gap, row_number() over (partition by s1 order by ce desc nulls last, block_rank) - 1 as ce_rank from (
    select *, row_number() over (partition by s1 order by score desc, cand) - 1 as block_rank, max(score) over (partition by s1) as m, count(*) over (partition by s1) as n_candidates from pairs)""", "pairs"))
def _(spark, d):
    c = windows.context_features(views.pairs(spark, d), gaps=("ce",), ranks=("ce",))
    return c.select(*PAIR, "block_rank", r6("block_score_rel").alias("block_score_rel"), "n_candidates", r6("ce_gap").alias("ce_gap"), "ce_rank")


@query("competition", sql("""select s1, cand, r - 1 as comp_rank, round(score - case when r = 1 then second else first end, 6) as comp_margin, n as comp_n_s1 from (
    select s1, cand, score, row_number() over w as r, first_value(score) over (w rows between unbounded preceding and unbounded following) as first, nth_value(score, 2) over (w rows between unbounded preceding and unbounded following) as second, count(*) over (partition by cand) as n
    from pairs window w as (partition by cand order by score desc nulls last, s1))""", "pairs"))
def _(spark, d):
    c = windows.competition(views.pairs(spark, d), "score", "comp")
    return c.select(*PAIR, "comp_rank", r6("comp_margin").alias("comp_margin"), "comp_n_s1")


_LOGIT = lambda c: f"ln(greatest(least({c}, 1 - 1e-6), 1e-6) / (1 - greatest(least({c}, 1 - 1e-6), 1e-6)))"


@query("stacker_context", sql(f"""select s1, cand, round({_LOGIT('score')}, 6) as lg, round({_LOGIT('ce')}, 6) as lc, rank() over (partition by s1 order by ce desc) as ce_rank, round(max(ce) over (partition by s1) - ce, 6) as ce_gap,
    rank() over (partition by s1 order by score desc) as gbdt_rank, count(*) over (partition by s1) as n_scored, round({_LOGIT('score')} - {_LOGIT('ce')}, 6) as disagree from pairs""", "pairs"))
def _(spark, d):
    c = windows.stacker_context(views.pairs(spark, d)).drop("country", "score", "label", "ce")
    return c.withColumns({x: r6(x) for x in ("lg", "lc", "ce_gap", "disagree")})


@query("hard_negatives", sql("select s1, cand, score from (select *, row_number() over (partition by s1 order by score desc, cand) as r from pairs where label = 0) where r <= 4", "pairs"))
def _(spark, d):
    return windows.head_of_group(views.pairs(spark, d).filter("label = 0"), 4).select(*PAIR, "score")


@query("sibling_partner", sql("select s1, cand, case when row_number() over w = 1 then nth_value(cand, 2) over (w rows between unbounded preceding and unbounded following) else first_value(cand) over (w rows between unbounded preceding and unbounded following) end as partner from pairs window w as (partition by s1 order by score desc, cand)", "pairs"))
def _(spark, d):
    return windows.sibling_partner(views.pairs(spark, d)).select(*PAIR, "partner")


@query("embedding_features", sql(f"""select s1, cand, round(emb_score, 6) as emb_cos, round(max(emb_score) over (partition by s1) - emb_score, 6) as emb_cos_gap, (score > 0)::int::double as from_token,
    row_number() over (partition by s1 order by emb_score desc nulls last, score desc, cand) - 1 as emb_cos_rank
    from (select coalesce(t.s1, e.s1) as s1, coalesce(t.cand, e.cand) as cand, coalesce(score, 0) as score, emb_score from {_TOKENS} t full join knn e on t.s1 = e.s1 and t.cand = e.cand)""", "knn"))
def _(spark, d):
    u = windows.embedding_features(candidates.candidate_union(_token_like(spark, d), knn.knn_blocks(views.vec(spark, d), 3)))
    return u.select(*PAIR, r6("emb_cos").alias("emb_cos"), r6("emb_cos_gap").alias("emb_cos_gap"), "from_token", "emb_cos_rank")


@query("stacker_extras", sql(f"""select s1, cand, round({_LOGIT('coalesce(ce2, ce)')}, 6) as lc2, round({_LOGIT('ce')} - {_LOGIT('coalesce(ce2, ce)')}, 6) as ce_rounds_diff, round({_LOGIT('ce_x')}, 6) as lx, round({_LOGIT('ce_x')} - {_LOGIT('ce')}, 6) as x_vs_ce
    from (select s1, cand, ce, case when cand % 2 = 0 then score end as ce2, case when cand % 3 = 0 then score end as ce_x from pairs)""", "pairs"))
def _(spark, d):
    p = views.pairs(spark, d).withColumns({"ce2": F.when(F.col(CAND) % 2 == 0, F.col("score")), "ce_x": F.when(F.col(CAND) % 3 == 0, F.col("score"))})
    out = windows.stacker_extras(windows.stacker_context(p))
    return out.select(*PAIR, *(r6(c).alias(c) for c in ("lc2", "ce_rounds_diff", "lx", "x_vs_ce")))


@query("best_per_candidate", sql("select s1, cand, ce from (select *, row_number() over (partition by cand order by ce desc, s1) as r from pairs) where r = 1", "pairs"))
def _(spark, d):
    return windows.best_per(views.pairs(spark, d), CAND, "ce").select(*PAIR, "ce")


@query("attach_texts", sql("select s1, cand, a.p_name as s1_name, b.p_name as cand_name from pairs left join part a on a.p_partkey = s1 left join part b on b.p_partkey = cand", "pairs"))
def _(spark, d):
    names = views.table(spark, d, "part").select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"))
    return candidates.attach(views.pairs(spark, d).select(*PAIR), names, ["name"])


@query("attach_features", sql("select p.s1, p.cand, p.score, f.ce from (select * from pairs where score >= 0.5) p left join (select * from pairs where cand % 3 <> 0) f on f.s1 = p.s1 and f.cand = p.cand", "pairs"))
def _(spark, d):
    p = views.pairs(spark, d)
    return candidates.attach_features(p.filter("score >= 0.5").select(*PAIR, "score"), p.filter(F.col(CAND) % 3 != 0), ["ce"])


@query("missing_ids", sql("select distinct cand as id from pairs where cand not in (select p_partkey from part where p_partkey % 10 <> 0)", "pairs"))
def _(spark, d):
    known = views.table(spark, d, "part").filter("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("entity_id"))
    return candidates.missing_ids(views.pairs(spark, d), known, CAND)


@query("semi_anti", sql("select s1, cand from pairs where s1 in (select s1 from pairs where score > 0.9) and cand not in (select cand from pairs where score < 0.001)", "pairs"))
def _(spark, d):
    p = views.pairs(spark, d)
    return candidates.anti(candidates.semi(p, p.filter("score > 0.9")), p.filter("score < 0.001"), [CAND]).select(*PAIR)


@query("ensemble_mean", sql("select s1, cand, round((score + ce + (score + ce) / 2) / 3, 6) as mean from pairs", "pairs"))
def _(spark, d):
    p = views.pairs(spark, d).withColumn("third", (F.col("score") + F.col("ce")) / 2)
    return p.select(*PAIR, r6(decide.ensemble_mean(["score", "ce", "third"])).alias("mean"))


@query("leak_check", sql("select s1 from (select s1 from pairs where score > 0.9 intersect select s1 from pairs where score < 0.1)", "pairs"))
def _(spark, d):
    p = views.pairs(spark, d)
    return p.filter("score > 0.9").select(S1).intersect(p.filter("score < 0.1").select(S1))


# ---- labels and metrics -----------------------------------------------------------------------------------------------


@query("truth_explode", sql("select s1, id as matched_id from listed", "listed"))
def _(spark, d):
    return labels.truth_pairs(views.id_rows(spark, d), "ids")


@query("true_count", sql("select s1, case when trim(ids) = '' then 0 else len(string_split(ids, ',')) end::int as n_true from id_rows", "id_rows"))
def _(spark, d):
    return views.id_rows(spark, d).select(S1, labels.true_count(F.col("ids")).alias("n_true"))


@query("label_pairs", sql("select p.s1, p.cand, (t.s1 is not null)::int as label from pairs p left join truth t on t.s1 = p.s1 and t.matched_id = p.cand", "truth"))
def _(spark, d):
    return labels.label_pairs(views.pairs(spark, d).drop("label"), views.truth(spark, d)).select(*PAIR, "label")


@query("entity_truth", sql("select o_orderkey as s1, (o_orderkey % 3)::varchar as country, coalesce(case when trim(ids) = '' then 0 else len(string_split(ids, ',')) end, 0)::int as n_true from orders left join id_rows r on r.s1 = o_orderkey::varchar", "id_rows"))
def _(spark, d):
    s1 = views.table(spark, d, "orders").select(F.col("o_orderkey").alias("entity_id"), (F.col("o_orderkey") % 3).cast("string").alias("country"))
    rows = views.id_rows(spark, d).withColumn(S1, F.col(S1).cast("long"))
    return labels.entity_truth(s1, rows, "ids")


@query("label_coverage", sql("""select country, count(*) as entities, count(*) filter (n_true = 0) as singletons, sum(n_true)::bigint as true_pairs, sum(f)::bigint as found_pairs, sum(n)::bigint as candidates, round(avg((n_true = f)::int), 6) as entities_all_found,
    round(sum(f) / sum(n_true), 6) as pair_recall, round(sum(f) / sum(n), 6) as positive_rate from entities join (select s1, count(*) as n, sum(label) as f from pairs group by s1) using (s1) group by country""", "entities"))
def _(spark, d):
    c = labels.label_coverage(views.pairs(spark, d), views.entities(spark, d))
    return c.withColumns({x: r6(x) for x in ("entities_all_found", "pair_recall", "positive_rate")})


@query("never_retrieved", sql("select t.s1, t.matched_id from truth t left join pairs p on p.s1 = t.s1 and p.cand = t.matched_id where p.s1 is null", "truth"))
def _(spark, d):
    return labels.never_retrieved(views.truth(spark, d), views.pairs(spark, d))


_F05 = "case when 1.25 * tp + 0.25 * (n_true - tp) + n_pred - tp > 0 then 1.25 * tp / (1.25 * tp + 0.25 * (n_true - tp) + n_pred - tp) else 1 end"
_SCORED = f"(select *, {_F05} as f05 from (select e.*, coalesce(tp, 0) as tp, coalesce(n_pred, 0) as n_pred from entities e left join (select s1, sum(label) as tp, count(*) as n_pred from pairs where score >= 0.5 group by s1) using (s1)))"


@query("entity_f05", sql(f"select s1, country, n_true, tp::bigint as tp, n_pred, round(f05, 6) as f05 from {_SCORED}", "entities"))
def _(spark, d):
    return metrics.entity_f05(views.entities(spark, d), views.pairs(spark, d), F.col("score") >= 0.5).withColumn("f05", r6("f05"))


@query("macro_f05", sql(f"select coalesce(country, 'ALL') as country, round(avg(f05), 6) as macro_f05, count(*) as entities from {_SCORED} group by grouping sets ((country), ())", "entities"))
def _(spark, d):
    m = metrics.macro_f05(metrics.entity_f05(views.entities(spark, d), views.pairs(spark, d), F.col("score") >= 0.5))
    return m.withColumn("macro_f05", r6("macro_f05"))


_GRID = "(select unnest(list_transform(range(1, 20), lambda i: i / 20)) as threshold)"
_SWEEP = f"(select threshold, avg({_F05}) as macro_f05 from (select threshold, e.n_true, coalesce(tp, 0) as tp, coalesce(n_pred, 0) as n_pred from entities e cross join {_GRID} g left join (select threshold, s1, sum(label) as tp, count(*) as n_pred from pairs join {_GRID} on score >= threshold group by all) p using (threshold, s1)) group by threshold)"


def _sweep(spark, d):
    grid = spark.range(1, 20).select((F.col("id") / 20).alias("threshold"))
    return metrics.threshold_sweep(views.entities(spark, d), views.pairs(spark, d), grid)


@query("threshold_sweep", sql(f"select round(threshold, 6) as threshold, round(macro_f05, 6) as macro_f05 from {_SWEEP}", "entities"))
def _(spark, d):
    return _sweep(spark, d).select(r6("threshold").alias("threshold"), r6("macro_f05").alias("macro_f05"))


@query("best_threshold", sql(f"select round(threshold, 6) as threshold, round(macro_f05, 6) as macro_f05 from {_SWEEP} order by round(macro_f05, 12) desc, threshold limit 1", "entities"))
def _(spark, d):
    return metrics.best_threshold(_sweep(spark, d)).select(r6("threshold").alias("threshold"), r6("macro_f05").alias("macro_f05"))


@query("threshold_grid", sql("select distinct round(t, 9) as threshold from (select unnest(list_concat(list_transform(range(1, 100), lambda i: i / 100), (select quantile_cont(score, list_transform(range(0, 200), lambda i: i / 199::double)) from pairs))) as t)", "pairs"))
def _(spark, d):
    return metrics.threshold_grid(views.pairs(spark, d)).select(F.round("threshold", 9).alias("threshold")).distinct()


@query("rate_threshold", sql("select score as threshold from (select score, row_number() over (order by score desc) as r, round_even(0.3 * count(*) over (), 0) as n from pairs) where r = n", "pairs"))
def _(spark, d):
    return metrics.rate_matched_threshold(views.pairs(spark, d), 0.3)


# ---- decisions --------------------------------------------------------------------------------------------------------


@query("select_matches", sql("select s1, cand, score from best", "best"))
def _(spark, d):
    return decide.select_matches(views.pairs(spark, d), 0.5).select(*PAIR, "score")


@query("score_override", sql("select s1, cand, case when cand % 3 = 0 then ce else score end as score from pairs", "pairs"))
def _(spark, d):
    p = views.pairs(spark, d)
    return decide.override(p.select(*PAIR, "score"), p.filter(F.col(CAND) % 3 == 0).select(*PAIR, F.col("ce").alias("score")))


@query("ambiguity", sql("select s1, cand, score, max((score between 0.2 and 0.95)::int) over (partition by s1) = 1 as ambiguous from pairs where score >= 0.01", "pairs"))
def _(spark, d):
    return decide.with_ambiguity(views.pairs(spark, d)).select(*PAIR, "score", "ambiguous")


@query("success_distribution", sql("""select s1, round((1 - p) * (1 - q), 6) as p0, round(p * (1 - q) + q * (1 - p), 6) as p1, round(p * q, 6) as p2 from (
    select s1, max(score) filter (r = 1) as p, max(score) filter (r = 2) as q from (select s1, score, row_number() over (partition by s1 order by score desc, cand) as r from pairs) where r <= 2 group by s1 having count(*) = 2)""", "pairs"))
def _(spark, d):
    two = blocking.top_k(views.pairs(spark, d), 2).groupBy(S1).agg(F.collect_list("score").alias("p")).filter("size(p) = 2")
    dist = two.select(S1, decide.success_distribution(F.col("p")).alias("x"))
    return dist.select(S1, *(r6(F.get("x", F.lit(i))).alias(f"p{i}") for i in range(3)))


_DIST = lambda p: f"list_reduce(list_transform({p}, lambda x: [x]), lambda d, x: list_transform(range(0, len(d) + 1), lambda i: coalesce(d[i + 1], 0) * (1 - x[1]) + coalesce(d[i], 0) * x[1]), [1.0::double])"


@query("expected_f", sql(f"""select s1, cand, score from (select *, row_number() over (partition by cand order by score desc, s1) as place from (
      select a.s1, a.cand, a.score from ranked a join chosen c using (s1) where a.r <= c.k
      union all select s1, cand, score from known where not ambiguous and score >= 0.75)) where place = 1""", "pairs").replace("\nselect s1, cand, score from (select *, row", f""",
    known as (select *, max((score between 0.2 and 0.95)::int) over (partition by s1) = 1 as ambiguous from pairs where score >= 0.01),
    ranked as (select *, row_number() over (partition by s1 order by score desc, cand) as r from known where ambiguous qualify r <= 30),
    lists as (select s1, list(score order by r) as p from ranked group by s1),
    tries as (select s1, k, {_DIST('p[1:k]')} as heads, {_DIST('p[k + 1:]')} as tails, len(p) - k as rest from (select s1, p, unnest(range(0, len(p) + 1)) as k from lists)),
    valued as (select s1, k, case when k = 0 then tails[1] else list_sum(flatten(list_transform(range(0, k + 1), lambda h: list_transform(range(0, rest + 1), lambda m:
      heads[h + 1] * tails[m + 1] * 1.25 * h / (1.25 * h + 0.25 * m + (k - h)))))) end as v from tries),
    chosen as (select s1, k from (select *, row_number() over (partition by s1 order by round(v, 12) desc, k) as place from valued) where place = 1)
select s1, cand, score from (select *, row"""))
def _(spark, d):
    return decide.expected_f_matches(views.pairs(spark, d), 0.75).select(*PAIR, "score")


@query("agreement_pairs", sql("select s1, cand, (score >= 0.9 and ce >= 0.9)::int as label from pairs where (score >= 0.9 and ce >= 0.9) or (ce <= 0.1 and score < 0.5)", "pairs"))
def _(spark, d):
    return decide.confident_agreement(views.pairs(spark, d), high=0.9, low=0.1).select(*PAIR, "label")


@query("not_both_confident", sql("select s1, cand from pairs where not (score >= 0.9 and ce >= 0.9)", "pairs"))
def _(spark, d):
    return decide.not_both_confident(views.pairs(spark, d), high=0.9).select(*PAIR)


@query("pseudo_labels", sql("select s1, cand, (score >= 0.98)::int as label from pairs where score >= 0.98 or score <= 0.02", "pairs"))
def _(spark, d):
    return decide.pseudo_labels(views.pairs(spark, d)).select(*PAIR, "label")


# ---- outputs and validation -------------------------------------------------------------------------------------------


@query("id_lists", sql("select o_orderkey as s1, coalesce(ids, '') as ids from orders left join (select s1, string_agg(cand, ',' order by score desc, cand) as ids from pairs where score >= 0.5 group by s1) p on p.s1 = o_orderkey", "pairs"))
def _(spark, d):
    ids = views.table(spark, d, "orders").select(F.col("o_orderkey").alias(S1))
    return sinks.id_lists(ids, views.pairs(spark, d).filter("score >= 0.5"))


@query("validate_duplicates", sql("select s1, count(*) as n from id_rows group by s1 having count(*) > 1", "id_rows"))
def _(spark, d):
    return validate.duplicate_rows(views.id_rows(spark, d))


@query("validate_repeated", sql("select s1 from id_rows where len(string_split(ids, ',')) <> len(list_distinct(string_split(ids, ',')))", "id_rows"))
def _(spark, d):
    return validate.repeated_ids(views.id_rows(spark, d))


@query("validate_self", sql("select s1, id from listed where id like 'S1-%'", "listed"))
def _(spark, d):
    return validate.self_matches(views.id_rows(spark, d))


@query("validate_prefix", sql("select s1, id from listed where not (id like 'S1-%' or id like 'S2-%' or id like 'S3-%')", "listed"))
def _(spark, d):
    return validate.wrong_prefix(views.id_rows(spark, d))


@query("validate_unknown", sql("select s1, id from listed where id not in (select case when p_partkey % 2 = 0 then 'S2-' else 'S3-' end || p_partkey from part where p_partkey % 10 <> 0)", "listed"))
def _(spark, d):
    k = F.col("p_partkey")
    known = views.table(spark, d, "part").filter(k % 10 != 0).select(F.concat(F.when(k % 2 == 0, "S2-").otherwise("S3-"), k.cast("string")).alias("id"))
    return validate.unknown_ids(views.id_rows(spark, d), known)


def _required(spark, d):
    return views.table(spark, d, "orders").filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").cast("string").alias(S1))


@query("validate_missing", sql("select o_orderkey::varchar as s1 from orders where o_orderkey % 7 <> 0 and o_orderkey::varchar not in (select s1 from id_rows)", "id_rows"))
def _(spark, d):
    return validate.missing_rows(views.id_rows(spark, d), _required(spark, d))


@query("validate_unexpected", sql("select distinct s1 from id_rows where s1 not in (select o_orderkey::varchar from orders where o_orderkey % 7 <> 0)", "id_rows"))
def _(spark, d):
    return validate.unexpected_rows(views.id_rows(spark, d), _required(spark, d))


@query("validate_subset", sql("select s1, id from listed where s1 || ' ' || id not in (select s1 || ' ' || case when cand % 2 = 0 then 'S2-' else 'S3-' end || cand from pairs where score >= 0.2)", "listed"))
def _(spark, d):
    name = F.concat(F.when(F.col(CAND) % 2 == 0, "S2-").otherwise("S3-"), F.col(CAND).cast("string"))
    lists = views.pairs(spark, d).filter("score >= 0.2").groupBy(F.col(S1).cast("string").alias(S1)).agg(F.array_join(F.collect_list(name), ",").alias("ids"))
    return validate.not_subset(views.id_rows(spark, d), lists)


@query("validate_counts", sql("select count(*) as rows, count(*) filter (ids = '') as empty_rows, count(*) filter (ids <> '') as non_empty_rows from id_rows", "id_rows"))
def _(spark, d):
    return validate.row_counts(views.id_rows(spark, d))


@query("validate_malformed", "select string_split(url, '/')[1] as s1, url as line from pages where url not like '%?%'")
def _(spark, d):
    lines = views.table(spark, d, "pages").select(F.col("url").alias("line"), F.regexp_replace("url", r"\?", "\t").alias("value"))
    rows = validate.malformed_rows(validate.parsed(lines.select("value")))
    return rows.select(F.split(S1, "/")[0].alias(S1), F.col(S1).alias("line"))


@query("validate_examples", sql("select count(distinct s1) as n_offenders, (select string_agg(s1, ',' order by s1) from (select distinct s1 from listed where id like 'S1-%' order by s1 limit 5)) as examples from listed where id like 'S1-%'", "listed"))
def _(spark, d):
    return validate.examples(validate.self_matches(views.id_rows(spark, d)))


@query("pred_summary", sql("select country, count(*) as entities, count(*) filter (c = 0) as no_candidates, round(avg((m = 0)::int), 6) as predicted_singletons, round(avg(m), 6) as mean_matches from (select e.s1, country, coalesce(c, 0) as c, coalesce(m, 0) as m from entities e left join (select s1, count(*) as c from pairs group by s1) using (s1) left join (select s1, count(*) as m from best group by s1) using (s1)) group by country", "entities", "best"))
def _(spark, d):
    p = views.pairs(spark, d)
    out = reports.prediction_summary(views.entities(spark, d).withColumnRenamed(S1, "entity_id"), p, decide.select_matches(p, 0.5))
    return out.withColumns({c: r6(c) for c in ("predicted_singletons", "mean_matches")})


_PRED = "(select p.*, b.s1 is not null as pred from pairs p left join best b on b.s1 = p.s1 and b.cand = p.cand)"
_ENT = f"(select *, {_F05} as f05 from (select e.*, coalesce(tp, 0) as tp, coalesce(n_pred, 0) as n_pred from entities e left join (select s1, sum(label) as tp, count(*) as n_pred from {_PRED} where pred group by s1) using (s1)))"
_ERR = f"""(select x.*, round(f05, 6) as entity_f05, round(1 - f05, 6) as entity_loss, country, n_true from (
    select 'FP' as error_type, s1, cand, score, label from {_PRED} where pred and label = 0 union all select 'FN', s1, cand, score, label from {_PRED} where not pred and label = 1
    union all select 'MISS', t.s1, t.matched_id, null, 1 from truth t left join pairs p on p.s1 = t.s1 and p.cand = t.matched_id where p.s1 is null) x join {_ENT} using (s1))"""


def _errors(spark, d):
    return reports.error_report(views.pairs(spark, d), views.truth(spark, d), views.entities(spark, d), 0.5)


@query("error_report", sql(f"select error_type, s1, cand, score, label, country, n_true, entity_f05, entity_loss from {_ERR}", "entities", "best"))
def _(spark, d):
    return _errors(spark, d)[0].withColumns({"entity_f05": r6("entity_f05"), "entity_loss": r6("entity_loss")})


@query("error_summary", sql(f"""select country, case when n_true = 0 and kinds = 'FP' then 'FP (true singleton)' else kinds end as kinds, count(*) as entities, round(sum(1 - f05) / (select count(*) from entities), 6) as loss_points
    from {_ENT} join (select s1, string_agg(distinct error_type, '+' order by error_type) as kinds from {_ERR} group by s1) using (s1) group by all""", "entities", "best"))
def _(spark, d):
    return reports.error_summary(*_errors(spark, d)).withColumn("loss_points", r6("loss_points"))


@query("list_errors", sql(f"select error_type, s1, cand, entity_loss from {_ERR} where error_type = 'FP' and country = '1' order by entity_loss desc, s1, error_type, cand limit 20 offset 10", "entities", "best"))
def _(spark, d):
    e = _errors(spark, d)[0].withColumn("entity_loss", r6("entity_loss"))
    return reports.list_errors(e, "FP", "1", offset=10, limit=20).select("error_type", *PAIR, "entity_loss")


@query("inspect_entity", sql("select cand, score, label, true as retrieved from pairs where s1 = 100 union all select t.matched_id, null, 1, false from truth t left join pairs p on p.s1 = t.s1 and p.cand = t.matched_id where p.s1 is null and t.s1 = 100", "truth"))
def _(spark, d):
    return reports.inspect_entity(views.pairs(spark, d), views.truth(spark, d), 100)


@query("inspect_record", sql("select * from rec where entity_id = 7", "rec"))
def _(spark, d):
    return reports.inspect_record(views.rec(spark, d), 7)


@query("inspect_pair", sql("select * from pairs where s1 = (select min(s1) from pairs) and cand = (select min(cand) from pairs where s1 = (select min(s1) from pairs))", "pairs"))
def _(spark, d):
    p = views.pairs(spark, d)
    first = p.agg(F.min(F.struct(*PAIR)).alias("x")).first()["x"]
    return reports.inspect_pair(p, first[S1], first[CAND]) if first is not None else p


# ---- sampling and exports ---------------------------------------------------------------------------------------------

_HASH = lambda c, seed=42: f"((({c})::hugeint + {seed}) * 2654435761 % 2147483647)::bigint"


@query("entity_split", sql(f"""select s1, country, n_true, case when r <= round_even(n * 0.15::double, 0) then 'val' when r <= round_even(n * 0.15::double, 0) + round_even(n * 0.05::double, 0) then 'early_stop' else 'fit' end as role from (
    select *, row_number() over (partition by country order by {_HASH('s1')}, s1) as r, count(*) over (partition by country) as n from entities)""", "entities"))
def _(spark, d):
    return sampling.entity_split(views.entities(spark, d), by=sampling.arithmetic_hash(F.col(S1)))


@query("sample_pairs", sql(f"select s1, cand from pairs order by {_HASH('s1 * 10000 + cand')}, s1, cand limit 500", "pairs"))
def _(spark, d):
    return sampling.sample(views.pairs(spark, d), 500, sampling.arithmetic_hash(F.col(S1) * 10000 + F.col(CAND)), PAIR).select(*PAIR)


@query("keep_then_fill", sql(f"select s1, cand from pairs where score > 0.95 union all select s1, cand from (select s1, cand, row_number() over (order by {_HASH('s1 * 10000 + cand')}, s1, cand) as r from pairs where not score > 0.95) where r <= greatest(0, (select count(*) from pairs) // 10 - (select count(*) from pairs where score > 0.95))", "pairs"))
def _(spark, d):
    p = views.pairs(spark, d)
    return sampling.keep_then_fill(p, F.col("score") > 0.95, p.count() // 10, sampling.arithmetic_hash(F.col(S1) * 10000 + F.col(CAND)), PAIR).select(*PAIR)


@query("sample_entities", sql(f"select s1, cand from pairs where {_HASH('s1')} % 1000000 < 200000", "pairs"))
def _(spark, d):
    return sampling.sample_entities(views.pairs(spark, d), 0.2, by=sampling.arithmetic_hash(F.col(S1))).select(*PAIR)


@query("fresh_entities", sql("select distinct s1 from pairs where s1 not in (select s1 from pairs where score > 0.9)", "pairs"))
def _(spark, d):
    p = views.pairs(spark, d)
    return exports.fresh_entities(p, p.filter("score > 0.9"))


def _texts(spark, d):
    return views.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))


@query("labelled_pairs", sql("""select p.s1, p.cand, coalesce(a.p_name, '') as text_a, coalesce(b.p_name, '') as text_b, label from (
    select s1, cand, label from pairs where label = 1 union all select s1, cand, label from (select *, row_number() over (partition by s1 order by score desc, cand) as r from pairs where label = 0) where r <= 4) p
    left join part a on a.p_partkey = p.s1 left join part b on b.p_partkey = p.cand""", "pairs"))
def _(spark, d):
    return exports.labelled_pairs(views.pairs(spark, d), _texts(spark, d))


@query("rescoring_pairs", sql("select p.s1, p.cand, coalesce(a.p_name, '') as text_a, coalesce(b.p_name, '') as text_b, label from pairs p left join part a on a.p_partkey = p.s1 left join part b on b.p_partkey = p.cand where score >= 0.02 and not (score >= 0.98 and ce >= 0.98)", "pairs"))
def _(spark, d):
    return exports.rescoring_pairs(views.pairs(spark, d), _texts(spark, d))


@query("agreement_export", sql("""select x.s1, x.cand, coalesce(a.p_name, '') as text_a, coalesce(b.p_name, '') as text_b, label from (
    select s1, cand, 1 as label from (select *, row_number() over (partition by cand order by ce desc, s1) as r from pairs where score >= 0.98 and ce >= 0.98 and country = '1') where r = 1
    union all select s1, cand, 0 from pairs where ce <= 0.02 and score < 0.5 and country = '1') x left join part a on a.p_partkey = x.s1 left join part b on b.p_partkey = x.cand""", "pairs"))
def _(spark, d):
    return exports.agreement_pairs(views.pairs(spark, d), _texts(spark, d), country="1")


@query("score_pairs", sql("select s1, cand, round(least(length(a.p_name), length(b.p_name)) / greatest(length(a.p_name), length(b.p_name)), 6) as ce from pairs p join part a on a.p_partkey = p.s1 join part b on b.p_partkey = p.cand", "pairs"))
def _(spark, d):
    p = exports.with_texts(views.pairs(spark, d), _texts(spark, d)).filter("text_a <> '' and text_b <> ''")
    scored = exports.score_pairs(p, lambda a, b: [min(len(x), len(y)) / max(len(x), len(y)) for x, y in zip(a, b)])
    return scored.select(*PAIR, r6("ce").alias("ce"))


@query("triplets", sql(f"""select a.p_name as anchor, p.p_name as positive, n.p_name as negative, t.s1 as anchor_id, t.matched_id as positive_id, neg as negative_id, country, found as blocking_found from (
    select t.s1, t.matched_id, (t.s1 % 3)::varchar as country, c.s1 is not null as found, l[({_HASH('t.s1 * 10000 + t.matched_id')} % len(l) + 1)::int] as neg from truth t
    left join pairs c on c.s1 = t.s1 and c.cand = t.matched_id
    join (select s1, list(cand order by r) as l from (select p.s1, p.cand, row_number() over (partition by p.s1 order by score desc, p.cand) as r from pairs p where label = 0 and s1 in (select s1 from truth)) where r <= 5 group by s1) n on n.s1 = t.s1) t
    left join part a on a.p_partkey = t.s1 left join part p on p.p_partkey = t.matched_id left join part n on n.p_partkey = neg""", "truth"))
def _(spark, d):
    t = views.truth(spark, d).withColumn("country", (F.col(S1) % 3).cast("string"))
    return exports.triplets(t, views.pairs(spark, d), _texts(spark, d), by=sampling.arithmetic_hash(F.col(S1) * 10000 + F.col("matched_id")))


@query("same_source_negatives", sql(rf"""with parts as (
      select entity_id as id, name || ', ' || address as text, string_split(name, ' ')[1] as head, array_to_string(list_sort(list_filter(list_transform(string_split(address, ','), lambda x: trim(x)), lambda x: x <> '' and not regexp_matches(x, '[0-9]'))), ',') as city,
        list_filter(list_transform(string_split(address, ','), lambda x: trim(x)), lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda t: regexp_full_match(t, '[0-9]+'))) > 0)[1] as street from addr where address is not null),
    kinds as (select city, 'head' as kind, head as of, id, text from parts where head <> '' union all select city, 'street', street, id, text from parts where street <> ''),
    follow as (select id, text, lead(id) over w as cand, lead(text) over w as text_b from kinds window w as (partition by city, kind, of order by {_HASH('id')}, id))
    select distinct id as s1, cand, 0 as label from follow where cand is not null and text <> text_b""", "addr").replace("\nwith parts as", ",\nparts as"))
def _(spark, d):
    a = views.addr(spark, d).filter("address is not null").select(F.col("entity_id").alias("id"), "name", "address")
    a = a.withColumn("text", text.record_text(F.col("name"), F.col("address")))
    return exports.same_source_negatives(a, by=sampling.arithmetic_hash(F.col("id"))).select(*PAIR, "label")


@query("word_freq", r"""with w as (select unnest(list_filter(regexp_split_to_array(p_name, '[\s,]+'), lambda t: t <> '')) as word from part)
    select word, count(*) as n from w where regexp_full_match(word, '[a-zA-Z]{3,}') and word not in (select unnest(regexp_split_to_array(lower(p_type), '[\s,]+')) from part) group by word having count(*) >= 10""")
def _(spark, d):
    return exports.word_frequency(views.table(spark, d, "part").select(F.col("p_name").alias("name"), F.lower("p_type").alias("address")), 10)


@query("synthetic_positives")
def _(spark, d):
    p = exports.with_texts(views.pairs(spark, d).filter("label = 1"), _texts(spark, d))
    return exports.synthetic_positives(p)


@query("synthetic_negatives")
def _(spark, d):
    p = exports.with_texts(views.pairs(spark, d).filter("label = 1"), _texts(spark, d)).filter("text_b <> ''")
    a = views.addr(spark, d).select(F.col("entity_id").alias(CAND), "address")
    vocabulary = exports.word_frequency(views.table(spark, d, "part").select(F.col("p_name").alias("name"), F.lower("p_type").alias("address")), 10)
    return exports.synthetic_negatives(p.join(a, CAND).select(*PAIR, "text_a", F.col("text_b").alias("name"), "address"), vocabulary)


# ---- features and models ----------------------------------------------------------------------------------------------


def _cleaned(spark, d):
    r = views.rec(spark, d)
    c = text.clean_records(r.select(F.concat("side", F.lit("-"), "entity_id").alias("entity_id"), "name", "address", "country"), name="name", address="address")
    is_s1 = F.col("entity_id").startswith("S1-")
    return c.filter(is_s1), c.filter(~is_s1)


def _features(spark, d):
    a, b = _cleaned(spark, d)
    parts = {f"address_{c}": c for c in ("present", "head", "middle", "tail")}
    records, is_s1 = staged(a.unionByName(b).drop(*parts), "records"), F.col("entity_id").startswith("S1-")  # read by the keys of both sides and by the corpus
    pairs = blocking.token_blocking(records.filter(is_s1), records.filter(~is_s1))
    whole = records.withColumn("_a", text.address_parts(F.col("address_normalized"))).withColumns({n: F.col(f"_a.{c}") for n, c in parts.items()}).drop("_a")
    return features.all_features(pairs, whole, done=lambda: delete(records))


@query("pair_features")
def _(spark, d):
    f = _features(spark, d)
    return f.select(*PAIR, "country", *(r6(c).alias(c) for c in features.feature_columns(f)))


_MODEL_FEATURES = ["ce", "block_rank", "block_score_rel", "n_candidates", "lg", "lc", "ce_rank", "ce_gap", "gbdt_rank"]


def _model_pairs(spark, d):
    return windows.stacker_context(windows.context_features(views.pairs(spark, d), gaps=(), ranks=()))


def _model_table(spark, d):
    p = _model_pairs(spark, d)
    roles = sampling.entity_split(views.entities(spark, d)).select(S1, "role")
    return p.join(roles, S1)


@query("gbt_score")
def _(spark, d):
    model = models.train_pairs(_model_table(spark, d), _MODEL_FEATURES, rounds=5)
    return model.score(_model_table(spark, d).filter("role = 'val'")).select(*PAIR, "score")


@query("gbt_importance")
def _(spark, d):
    return models.train_pairs(_model_table(spark, d), _MODEL_FEATURES, rounds=5).importance(spark)


@query("stacker_oof")
def _(spark, d):
    return models.out_of_fold(_model_table(spark, d), _MODEL_FEATURES, seeds=(1, 2), rounds=3).select(*PAIR, "stacked")


@query("loco")
def _(spark, d):
    entities = staged(views.entities(spark, d), "entities")
    return models.leave_one_country_out(_model_pairs(spark, d).join(entities.select(S1), S1), entities, _MODEL_FEATURES)


@query("pseudo_label_run")
def _(spark, d):
    t = _model_table(spark, d)
    return models.pseudo_label_run(t.filter("country <> '2'"), t.filter("country = '2'"), _MODEL_FEATURES, rounds=3).select(*PAIR, "score")


@query("fit_blend")
def _(spark, d):
    a, b, c = models.fit_blend(views.pairs(spark, d))
    return spark.createDataFrame([(a, b, c)], "a double, b double, c double")


@query("link")
def _(spark, d):
    from .linkage import Config, link

    a, b = _cleaned(spark, d)
    return link(a, b, config=Config(threshold=0.75)).select(*PAIR, r6("score").alias("score"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: token blocking."""
    return QUERIES["token_blocking"](spark, sf_dir)
