"""Registered queries of the retrieval engine and their SQL, over the driver's tables.

documents is the corpus, benchmark the query set, events give documents their dates
(doc_id = event_id), pages the URLs, conversations texts of several fields. Every query reads whole
tables; rules of single tokens run over all distinct tokens of a table's texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import rules as R
from .functions import urls as U
from .functions.dates import age_minutes, post_time
from .functions.stem import stem_sql, stem_vocabulary
from .functions.words import DATE, EMOJI, NUMBER, PUNCTUATION, STOP_WORDS
from .operators import correct, index, joins, parse, rank, sentences
from .plans import blocks, engine, lsi, storage
from .sources import corpus as sources
from .streaming import append

K = 10
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


# ---------------------------------------------------------------- pieces


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _freq(spark: SparkSession, d: str) -> DataFrame:
    return index.term_frequencies(_table(spark, d, "documents"), R.simple_tokens(F.col("text")))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return index.simple_terms(storage.spread(_table(spark, d, "documents")))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    b = _table(spark, d, "benchmark")
    return index.simple_terms(b.withColumnRenamed("item_id", "query_num"), "query_num")


def _words(spark: SparkSession, d: str, table: str, *columns: str) -> DataFrame:
    """Distinct tokens between blanks of a table's text columns."""
    t = storage.spread(_table(spark, d, table))
    return t.select(F.explode(F.array_distinct(F.concat(*[_blank_tokens(F.col(c)) for c in columns]))).alias("token")).distinct()


def _blank_tokens(text):
    return R.simple_tokens(text, BLANK_TOKEN, lower=False)


def _dates(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").alias("created_at"))


def _lit(x) -> str:
    return "null" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


#: What lies between blanks.
BLANK_TOKEN = r"[^ \t\n\r\f\x0B]+"


def _sql_words(table: str, *columns: str) -> str:
    return f"w as (select distinct unnest({' || '.join(f'regexp_extract_all({c}, {_lit(BLANK_TOKEN)})' for c in columns)}) as token from {table})"


TOK = "tok as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from documents)"
TF = TOK + ", tf as (select doc_id, term, count(*) as tf from tok group by doc_id, term), freq as (select *, max(tf) over (partition by doc_id) as max_tf, tf / max(tf) over (partition by doc_id) as ntf from tf)"
VOC = TF + ", voc as (select term, count(*) as df from tf group by term having count(*) > 1)"
ASK = "qtok as (select item_id as query_num, unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from benchmark)"
WEIGHTS = "q as (select query_num, term, count(*) as tf from qtok group by query_num, term), w as (select query_num, term, tf, tf / max(tf) over (partition by query_num) as w from q), qn as (select query_num, sqrt(sum(w * w)) as q_norm from w group by query_num)"
SCORES = (
    "idf as (select term, df, ln((select count(*) from documents) / df) / ln(10.0::double) as idf from voc), "
    "hit as (select w.query_num, f.doc_id, w.w, idf.idf * f.ntf as x from w join idf on w.term = idf.term join freq f on f.term = w.term), "
    "cos as (select hit.query_num, hit.doc_id, round(case when sum(x * x) > 0 then sum(hit.w * x) / (sqrt(sum(x * x)) * any_value(q_norm)) else 0 end, 6) as score from hit join qn on hit.query_num = qn.query_num group by hit.query_num, hit.doc_id)"
)
RANKED = f"select query_num, doc_id, score, rnk from (select cos.*, row_number() over (partition by query_num order by score desc, ts desc nulls last, doc_id) as rnk from cos left join events on events.event_id = cos.doc_id) where rnk <= {K}"
STOPS = "(" + ", ".join(map(_lit, STOP_WORDS)) + ")"

# ---------------------------------------------------------------- tokens and counts


@query(f"with {TOK} select term, count(*) as n from tok group by term")
def token_counts(spark, d):
    return _terms(spark, d).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, len(regexp_extract_all(lower(text), '[a-z]+'))::int as doc_length from documents")
def doc_length(spark, d):
    return storage.spread(_table(spark, d, "documents")).select("doc_id", F.size(R.simple_tokens(F.col("text"))).alias("doc_length"))


@query(f"with {TF} select doc_id, term, tf from tf")
def term_frequency(spark, d):
    return _freq(spark, d).select("doc_id", "term", "tf")


@query(f"with {TF} select doc_id, max(tf) as max_tf from tf group by doc_id")
def max_tf(spark, d):
    return _freq(spark, d).groupBy("doc_id").agg(F.max("tf").alias("max_tf"))


@query(f"with {TF} select doc_id, term, round(ntf, 9) as ntf from freq")
def normalized_tf(spark, d):
    return _freq(spark, d).select("doc_id", "term", F.round("ntf", 9).alias("ntf"))


@query("with t as (select doc_id, regexp_extract_all(lower(text), '[a-z]+') as a from documents), p as (select doc_id, unnest(a) as term, generate_subscripts(a, 1) - 1 as pos from t) select doc_id, term, string_agg(pos, ',' order by pos) as positions from p group by doc_id, term")
def term_positions(spark, d):
    freq = index.term_frequencies(_table(spark, d, "documents"), R.simple_tokens(F.col("text")), positions=True)
    return freq.select("doc_id", "term", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@query(f"with {TF} select term, count(*) as df from tf group by term")
def document_frequency(spark, d):
    return index.vocabulary(_freq(spark, d))


@query(f"with {VOC} select term, df from voc")
def hapax_pruned_vocabulary(spark, d):
    return index.vocabulary(_freq(spark, d), 2)


@query(f"with {TOK} select doc_id, term, count(*) as tf from tok where term not in {STOPS} group by doc_id, term")
def stopword_filtered_tf(spark, d):
    return index.term_frequencies(_table(spark, d, "documents"), parse.without_stop_words(R.simple_tokens(F.col("text")))).select("doc_id", "term", "tf")


def _counted(spark, d) -> tuple[DataFrame, DataFrame]:
    """(frequencies, vocabulary of terms of two documents or more), both written: documents are read once."""
    freq = storage.written(_freq(spark, d))
    return freq, storage.written(index.vocabulary(freq, 2))


@query(f"with {VOC} select f.term, f.doc_id, f.tf, round(f.ntf, 9) as ntf from freq f join voc on voc.term = f.term")
def postings_lists(spark, d):
    return index.postings(*_counted(spark, d)).withColumn("ntf", F.round("ntf", 9))


@query(f"with {TF} select doc_id, (select len(regexp_extract_all(lower(x.text), '[a-z]+')) from documents x where x.doc_id = tf.doc_id)::int as doc_length, max(tf) as max_tf, (select max(ts) from events where event_id = tf.doc_id) as created_at from tf group by doc_id")
def doc_metadata(spark, d):
    return index.doc_stats(_freq(spark, d), doc_length(spark, d), _dates(spark, d)).select("doc_id", "doc_length", "max_tf", "created_at")


@query(f"with {VOC} select (select count(*) from documents) as n_docs, (select count(*) from voc) as n_terms, (select count(*) from freq f join voc on f.term = voc.term) as n_postings, (select count(*) from tok) as n_tokens, (select sum(len(regexp_extract_all(text, '[0-9]+')))::bigint from documents) as n_numbers")
def corpus_stats(spark, d):
    docs = storage.spread(_table(spark, d, "documents"))
    vocab = index.vocabulary(_freq(spark, d), 2)
    a = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size(R.simple_tokens(F.col("text"))).cast("long")).alias("n_tokens"), F.sum(F.regexp_count("text", F.lit("[0-9]+")).cast("long")).alias("n_numbers"))
    # one row by one row
    return a.crossJoin(vocab.agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("n_postings"))).select("n_docs", "n_terms", "n_postings", "n_tokens", "n_numbers")


@query(f"with {TF} select term, row_number() over (order by term) - 1 as id from (select distinct term from tf)")
def term_ordinals(spark, d):
    return index.ordinals(_terms(spark, d), "term")


# ---------------------------------------------------------------- weights and ranking


@query(f"with {VOC} select term, round(ln((select count(*) from documents) / df) / ln(10.0::double), 9) as idf from voc")
def idf(spark, d):
    n = float(_table(spark, d, "documents").count())
    return index.vocabulary(_freq(spark, d), 2).select("term", F.round(rank.idf(F.lit(n), F.col("df")), 9).alias("idf"))


@query(f"with {VOC} select f.doc_id, f.term, round(ln((select count(*) from documents) / df) / ln(10.0::double) * f.ntf, 9) as tfidf from freq f join voc on f.term = voc.term")
def tfidf(spark, d):
    n = float(_table(spark, d, "documents").count())
    freq, vocab = _counted(spark, d)
    weighed = joins.join_terms(freq, vocab.withColumn("n", F.col("df")), ["term"], "n")
    return weighed.select("doc_id", "term", F.round(rank.idf(F.lit(n), F.col("df")) * F.col("ntf"), 9).alias("tfidf"))


@query(f"with {ASK}, {WEIGHTS} select w.query_num, term, tf, round(w, 9) as w, round(q_norm, 9) as q_norm, count(*) over (partition by w.query_num) as n_terms from w join qn on w.query_num = qn.query_num")
def query_weights(spark, d):
    return rank.query_weights(_asked(spark, d)).withColumn("w", F.round("w", 9)).withColumn("q_norm", F.round("q_norm", 9))


def _hits(freq: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(weights, frequencies of the queries' terms, their vocabulary): all that a search without an index needs, of one pass over ``freq``."""
    weights = storage.written(rank.query_weights(asked))
    hits = storage.written(freq.join(joins.small(weights.select("term").distinct()), "term", "left_semi"))
    return weights, hits, index.vocabulary(hits, 2)


@query(f"with {VOC}, {ASK} select distinct qtok.query_num, f.doc_id from qtok join voc on voc.term = qtok.term join freq f on f.term = voc.term")
def candidate_docs(spark, d):
    weights, hits, vocab = _hits(_freq(spark, d), _asked(spark, d))
    return rank.candidates(weights, hits.join(joins.small(vocab), "term", "left_semi"))


def _cosine(spark, d, freq: DataFrame, asked: DataFrame) -> DataFrame:
    weights, hits, vocab = _hits(freq, asked)
    return rank.cosine_scores(weights, hits, vocab, _table(spark, d, "documents").count())


@query(f"with {VOC}, {ASK}, {WEIGHTS}, {SCORES} select query_num, doc_id, score from cos")
def cosine_scores(spark, d):
    return _cosine(spark, d, _freq(spark, d), _asked(spark, d))


@query(f"with {VOC}, {ASK}, {WEIGHTS}, {SCORES} {RANKED}")
def topk_search(spark, d):
    return rank.top_results(cosine_scores(spark, d), K, _dates(spark, d))


ONE = "qtok as (select query_num, min(term) as term from (select item_id as query_num, unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from benchmark) group by query_num)"


@query(f"with {VOC}, {ONE}, {WEIGHTS}, {SCORES} {RANKED}")
def topk_recency_tiebreak(spark, d):
    one = _asked(spark, d).groupBy("query_num").agg(F.min("term").alias("term"))
    return rank.top_results(_cosine(spark, d, _freq(spark, d), one), K, _dates(spark, d))


# ---------------------------------------------------------------- correction

BROKEN = "qtok as (select query_num, case when length(term) > 5 then substr(term, 1, 2) || substr(term, 4, 1) || substr(term, 3, 1) || substr(term, 5) else term end as term from (select item_id as query_num, unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from benchmark))"
OOV = "oov as (select distinct term from qtok where lower(term) not in (select term from voc) and upper(term) not in (select term from voc))"
FOUND = OOV + ", cand as (select distinct oov.term, voc.term as candidate, voc.df from oov join voc on abs(length(oov.term) - length(voc.term)) <= 1 and damerau_levenshtein(oov.term, voc.term) <= 1), best as (select term, candidate from (select *, row_number() over (partition by term order by df desc, candidate) as r from cand) where r = 1)"


def _broken(spark, d) -> DataFrame:
    """The queries with the third and fourth letters of longer words swapped."""
    t = F.col("term")
    swapped = F.concat(F.substring(t, 1, 2), F.substring(t, 4, 1), F.substring(t, 3, 1), F.substr(t, F.lit(5)))
    return _asked(spark, d).select("query_num", F.when(F.length(t) > 5, swapped).otherwise(t).alias("term"))


@query(f"with {VOC}, {BROKEN}, {OOV} select term from oov")
def oov_query_terms(spark, d):
    return correct.unknown_terms(_broken(spark, d), index.vocabulary(_freq(spark, d), 2))


@query(f"with {VOC}, {BROKEN}, {FOUND} select term, candidate, df from cand")
def spell_candidates(spark, d):
    vocab = storage.written(index.vocabulary(_freq(spark, d), 2))
    return correct.spell_candidates(correct.unknown_terms(_broken(spark, d), vocab), vocab)


@query(f"with {VOC}, {BROKEN.replace('qtok as', 'asked as')}, {FOUND.replace('from qtok', 'from asked')}, qtok as (select asked.query_num, coalesce(best.candidate, asked.term) as term from asked left join best on best.term = asked.term), {WEIGHTS}, {SCORES} {RANKED}")
def spell_corrected_search(spark, d):
    freq, vocab = _counted(spark, d)
    fixed = correct.correct_queries(_broken(spark, d), vocab)
    return rank.top_results(_cosine(spark, d, freq, fixed), K, _dates(spark, d))


CASED = "ctok as (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) as raw from documents), cterm as (select doc_id, case when regexp_matches(raw, '^[A-Z]') then upper(raw) else lower(raw) end as term from ctok)"


def _cased(spark, d) -> DataFrame:
    tokens = F.transform(R.simple_tokens(F.col("text"), "[A-Za-z]+", lower=False), R.capital_form)
    return index.term_frequencies(_table(spark, d, "documents"), tokens)


@query(f"with {CASED}, v as (select term, count(distinct doc_id) as df from cterm group by term having count(distinct doc_id) > 1), asked as (select item_id as query_num, upper(unnest(regexp_extract_all(text, '[A-Za-z]+'))) as term from benchmark), forms as (select distinct term from asked) select forms.term, coalesce(a.term, b.term) as found from forms left join v a on a.term = forms.term left join v b on b.term = lower(forms.term)")
def case_fallback(spark, d):
    vocab = storage.written(index.vocabulary(_cased(spark, d), 2))
    asked = index.simple_terms(_table(spark, d, "benchmark"), "item_id", pattern="[A-Za-z]+", lower=False)
    return correct.case_fallback(asked.select(F.upper("term").alias("term")).distinct(), vocab)


@query(f"with {CASED}, low as (select distinct term from cterm where term = lower(term)), folded as (select c.doc_id, case when c.term = upper(c.term) and low.term is not null then low.term else c.term end as term from cterm c left join low on low.term = lower(c.term)) select term, count(distinct doc_id) as df, count(*) as tf from folded group by term")
def casefold_vocabulary(spark, d):
    return index.folded_vocabulary(_table(spark, d, "documents"), R.simple_tokens(F.col("text"), "[A-Za-z]+", lower=False))


IS_TITLE = "regexp_matches({}, '^\\P{{L}}*(?:[\\p{{Lu}}\\p{{Lt}}][\\p{{Ll}}\\p{{Lo}}\\p{{Lm}}]*(?:\\P{{L}}+|$))+$')"
HEAD, TAIL = "regexp_extract(token, '^([^-]*)-', 1)", "regexp_extract(token, '^[^-]*(-.*)$', 1)"
ENTITY = (
    f"t as (select doc_id, regexp_extract_all(text, {_lit(BLANK_TOKEN)}) as a from documents), p as (select doc_id, unnest(a) as token, generate_subscripts(a, 1) as pos from t), "
    f"k as (select *, case when {IS_TITLE.format('token')} then case when regexp_full_match(token, '\\p{{L}}+') then 'A' else 'T' end "
    f"when contains(token, '-') and {IS_TITLE.format(HEAD)} and {IS_TITLE.format(TAIL)} then 'T' end as kind from p), "
    "i as (select *, pos - row_number() over (partition by doc_id order by pos) as island from k where kind is not null), "
    "f as (select *, min(case when kind = 'A' then pos end) over (partition by doc_id, island) as first from i), "
    "e as (select doc_id, min(pos) - 1 as pos, string_agg(token, ' ' order by pos) as entity from f where pos >= first group by doc_id, island having count(*) >= 2)"
)


def _entities(spark, d) -> DataFrame:
    """Runs of title-case tokens between blanks, as the rule of the parser finds them."""
    docs = storage.spread(_table(spark, d, "documents"))
    rows = docs.select("doc_id", F.explode(F.array(_blank_tokens(F.col("text")))).alias("t"))
    return rows.select("doc_id", F.explode(parse.entity_phrases(F.col("t"))).alias("e")).select("doc_id", "e.pos", F.col("e.phrase").alias("entity"))


@query(f"with {ENTITY} select doc_id, pos::int as pos, entity from e")
def entities(spark, d):
    return _entities(spark, d)


@query(f"with {ENTITY} select entity, count(*) as n from e group by entity having count(*) >= 2")
def entity_pruned(spark, d):
    terms = _entities(spark, d).select("doc_id", F.col("entity").alias("term"), F.lit(True).alias("is_entity"))
    return index.prune_entities(terms).groupBy(F.col("term").alias("entity")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- sentences, learned from the corpus

_P_TYPE = "case when {w} and regexp_matches(regexp_replace({t}, '\\.$', ''), '^[\\p{{Nd}}.,-]+$') then '#' when {w} then lower(regexp_replace({t}, '\\.$', '')) else lower({t}) end"
_P_WORD = "coalesce(regexp_matches({t}, '^[\\p{{L}}\\p{{Nd}}]'), false)"
_P_STOP = _P_WORD + " and {t} like '%.' and not coalesce({n} like '.%', false)"
_P_UPPER = "upper(left({t}, 1)) = left({t}, 1) and lower(left({t}, 1)) <> left({t}, 1)"
_P_ASSOC = (
    "-2 * (({ab} * ln({p}) + ({a} - {ab}) * ln(1 - {p})) + (({b} - {ab}) * ln({p}) + (nn - {a} - {b} + {ab}) * ln(1 - {p})) "
    "- case when {ab} / {a} > 0 and {ab} / {a} < 1 then {ab} * ln({ab} / {a}) + ({a} - {ab}) * ln(1 - {ab} / {a}) else 0 end "
    "- case when ({b} - {ab}) / (nn - {a}) > 0 and ({b} - {ab}) / (nn - {a}) < 1 then ({b} - {ab}) * ln(({b} - {ab}) / (nn - {a})) + (nn - {a} - {b} + {ab}) * ln(1 - ({b} - {ab}) / (nn - {a})) else 0 end)"
)
SQL_COUNTS = (
    f"pa as (select doc_id, regexp_extract_all(text, {_lit(sentences.TOKEN)}) as a from documents), pt as (select doc_id, unnest(a) as tok, generate_subscripts(a, 1) - 1 as pos from pa), "
    "pn as (select *, lag(tok) over (partition by doc_id order by pos) as bef, lead(tok) over (partition by doc_id order by pos) as aft from pt), "
    f"pr as (select doc_id, pos, tok, aft, {_P_TYPE.format(t='tok', w=_P_WORD.format(t='tok'))} as type, {_P_STOP.format(t='tok', n='aft')} as stop, {_P_UPPER.format(t='tok')} as up, "
    f"case when bef is null then 's' when bef in ('!', '?') then 'b' when {_P_STOP.format(t='bef', n='tok')} then 'p' else 'i' end as kind, {_P_TYPE.format(t='bef', w=_P_WORD.format(t='bef'))} as btype from pn), "
    "pc as (select type, stop, up, kind, case when kind = 'p' then btype end as before, count(*)::double as n from pr group by all), "
    "tot as (select sum(n) as nn, sum(case when stop then n else 0 end) as ns from pc), "
    "ab as (select type, sum(case when stop then n else 0 end) as a, sum(case when stop then 0 else n end) as b, length(replace(type, '.', '')) as ch from pc group by type having sum(case when stop then n else 0 end) > 0 and regexp_matches(type, '\\p{L}')), "
    "sc as (select type, a, b, 2 * (a * ln(0.99) + b * ln(0.01) - (a * ln(ns / nn) + case when b > 0 then b * ln(1 - ns / nn) else 0 end)) * exp(-ch) * (length(type) - ch + 1) * pow(ch, -b) as score from ab, tot)"
)
SQL_SENTENCES = (
    SQL_COUNTS + f", short as (select type from sc where score >= {sentences.ABBREVIATION}), "
    "pk as (select *, before is not null and before in (select type from short) as sh, coalesce(before = '#' or regexp_full_match(before, '\\p{L}'), false) as lone, regexp_matches(type, '^[\\p{L}\\p{Nd}#]') as w from pc), "
    "ty as (select type, sum(n) as n, sum(case when regexp_full_match(type, '\\p{L}+') and (kind = 'b' or (kind = 'p' and not sh and not lone)) then n else 0 end) as nb, bool_or(w and not up) as low, bool_or(w and up) as hi, bool_or(up and kind = 'i') as mid, bool_or(w and not up and (kind in ('s', 'b') or (kind = 'p' and not sh))) as beglow from pk group by type), "
    "br as (select (select coalesce(sum(n), 0) from pc where stop and type not in (select type from short)) + (select coalesce(sum(n), 0) from pc where type in ('!', '?')) as x, nn from tot), "
    f"start as (select type from ty, br where nb > 0 and {_P_ASSOC.format(a='x', b='n', ab='nb', p='(n / nn)')} >= {sentences.STARTER} and nn * nb > x * n), "
    "pp as (select before, type, sum(n) as np from pk where lone and w group by before, type having sum(n) > 1), "
    f"coll as (select before, type from (select pp.before, pp.type, np, x.n as n1, y.n as n2 from pp join ty x on x.type = pp.before join ty y on y.type = pp.type where x.n > 1 and y.n > 1 and np <= least(x.n, y.n)), tot where {_P_ASSOC.format(a='n1', b='n2', ab='np', p='(n2 / nn)')} >= {sentences.COLLOCATION} and nn * np > n1 * n2), "
    "op as (select distinct pk.before, pk.type, up, sh, pk.before = '#' as num, regexp_full_match(pk.before, '\\p{L}') as ini, low, pk.type in (select type from start) as st, (pk.before, pk.type) in (select (before, type) from coll) as bound, "
    "case when not w then 'F' when up and low and not mid then 'T' when not up and (hi or not beglow) then 'F' else 'U' end as o from pk join ty on ty.type = pk.type where kind = 'p'), "
    "dec as (select before, type, up, case when bound then false when sh and not ini and (o = 'T' or (up and st)) then true when (ini or num) and o = 'F' then false when ini and o = 'U' and up and not low then false else not sh end as is_break from op)"
)


@query(f"with {SQL_COUNTS} select type, a::bigint as n_with, b::bigint as n_without, round(score, 6) + 0.0 as score from sc")
def abbreviation_scores(spark, d):
    """How likely each type that a full stop follows is an abbreviation."""
    counts = storage.written(sentences.token_counts(_table(spark, d, "documents")))
    return sentences.abbreviation_scores(counts).withColumn("score", F.round("score", 6) + 0.0)


@query(f"with {SQL_SENTENCES} select pr.doc_id, pos::int as pos, case when tok in ('!', '?') then true else is_break end as is_break from pr left join (select pr2.doc_id, pr2.pos - 1 as at, pr2.btype, pr2.type as t2, pr2.up as u2 from pr pr2) nx on nx.doc_id = pr.doc_id and nx.at = pr.pos left join dec on dec.before = pr.type and dec.type = nx.t2 and dec.up = nx.u2 where pr.aft is not null and (pr.stop or pr.tok in ('!', '?'))")
def sentence_boundaries(spark, d):
    """Which full stops and marks end sentences, by the model learned from the same texts."""
    docs = _table(spark, d, "documents")
    return sentences.boundaries(docs, sentences.learn_sentences(docs))


# ---------------------------------------------------------------- rules for posts, over the tables' own texts


@query(
    "with t as (select doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') as a from documents), p as (select doc_id, unnest(a) as token, generate_subscripts(a, 1) as i, len(a) as n from t), "
    "m as (select *, regexp_matches(token, '^[@#]') as mark from p), r as (select *, i - row_number() over (partition by doc_id, mark order by i) as island from m), "
    "k as (select *, (row_number() over (partition by doc_id, mark, island order by i) - 1) % 2 = 0 as even from r), "
    "l as (select *, coalesce(lag(mark and even) over (partition by doc_id order by i), false) as taken from k) "
    "select d.doc_id, coalesce(string_agg(token, ' ' order by i), '') as kept from documents d left join (select * from l where case when mark then even and i = n else not taken end) l on l.doc_id = d.doc_id group by d.doc_id"
)
def mention_drop(spark, d):
    """Texts without the tokens that @ and # take, by pairs from the left."""
    tokens = F.filter(F.split("text", " "), lambda x: x != "")
    left = F.transform(F.filter("x", lambda x: x["f"] != "A"), lambda x: x["t"])
    return parse.kept_tokens(storage.spread(_table(spark, d, "documents").select("doc_id", "text")), tokens).select("doc_id", F.coalesce(F.array_join(left, " "), F.lit("")).alias("kept"))


@query(f"with {_sql_words('documents', 'text')} select token, array_to_string(list_transform(regexp_extract_all(string_split(token, '#')[1], '[A-Z]*[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9_-]+'), lambda x: lower(x)), ' ') as pieces from w")
def hashtag_split(spark, d):
    return _words(spark, d, "documents", "text").select("token", F.array_join(R.split_hashtag(F.col("token")), " ").alias("pieces"))


@query(f"with {_sql_words('documents', 'text')} select token, case when len(list_filter(string_split(token, '-'), lambda x: regexp_full_match(x, '\\p{{L}}+'))) > 0 then array_to_string(list_transform(list_filter(string_split(token, '-'), lambda x: x <> ''), lambda x: lower(x)), ' ') else token end as parts from w where contains(token, '-')")
def hyphen_split(spark, d):
    return _words(spark, d, "documents", "text").where(F.col("token").contains("-")).select("token", F.array_join(R.split_hyphen(F.col("token")), " ").alias("parts"))


@query(f"with {_sql_words('pages', 'url', 'html')} select token, case when contains(token, '/') and not contains(token, '//t') then array_to_string(list_filter(string_split(token, '/'), lambda x: length(x) > 1), ' ') else '' end as parts from w")
def slash_split(spark, d):
    return _words(spark, d, "pages", "url", "html").select("token", F.array_join(R.split_slash(F.col("token")), " ").alias("parts"))


@query(f"with {_sql_words('documents', 'text')} select token, not regexp_matches(token, '\\p{{L}}') and regexp_matches(token, '\\p{{Nd}}{{1,4}}[-./]\\p{{Nd}}{{1,4}}') as is_date from w")
def date_tokens(spark, d):
    return _words(spark, d, "documents", "text").select("token", R.is_date(F.col("token")).alias("is_date"))


NUM_CASES = "case when a in ('usd', 'aud', '$') then '$' when a in ('eur', '€') then '€' when a = '£' then '£' when a in ('percent', 'percentage', '%') then '%' else '' end"
NUM_FMT = "regexp_replace(printf('%.3f', {}), '(\\.\\d*?[1-9]|\\.0)0+$', '\\1')"
#: The term of an integer s with value x, between words b and f in lower case.
NUM_TERM = (
    "sb || case when sf <> '' then plain || sf "
    f"when f in ('thousand', 'thousands') then case when x < 1000 then plain || 'K' when x < 1e6 then {NUM_FMT.format('x / 1000')} || 'M' else {NUM_FMT.format('x / 1e6')} || 'B' end "
    f"when f in ('million', 'millions') then case when x < 1000 then plain || 'M' else {NUM_FMT.format('x / 1000')} || 'B' end "
    "when f in ('billion', 'billions') then plain || 'B' when x < 1000 then plain "
    f"when x < 1e6 then {NUM_FMT.format('x / 1000')} || 'K' when x < 1e9 then {NUM_FMT.format('x / 1e6')} || 'M' else {NUM_FMT.format('x / 1e9')} || 'B' end"
)
NUM_STEPS = f"c as (select *, coalesce(try_cast(s as decimal(38,0))::varchar, s) as plain, {NUM_CASES.replace(' a ', ' b ')} as sb, {NUM_CASES.replace(' a ', ' f ')} as sf from m)"
INTEGER = "[0-9]+(,[0-9]{3})*"


@query(
    f"with t as (select doc_id, regexp_extract_all(text, {_lit(BLANK_TOKEN)}) as a from documents), p as (select doc_id, unnest(a) as token, generate_subscripts(a, 1) - 1 as pos, a from t), "
    f"m as (select doc_id, pos::int as pos, coalesce(lower(a[pos]), '') as b, coalesce(lower(a[pos + 2]), '') as f, replace(token, ',', '') as s, replace(token, ',', '')::double as x from p where regexp_full_match(token, '{INTEGER}')), {NUM_STEPS} "
    f"select doc_id, pos, {NUM_TERM} as term from c"
)
def number_normalize(spark, d):
    """Terms of all integers of the texts, between the words beside them."""
    t = storage.spread(_table(spark, d, "documents")).select("doc_id", F.explode(F.array(_blank_tokens(F.col("text")))).alias("a"))
    rows = t.select("doc_id", F.posexplode(F.transform("a", lambda x, i: F.struct(x.alias("x"), F.get(F.col("a"), i - 1).alias("b"), F.get(F.col("a"), i + 1).alias("f")))).alias("pos", "y")).where(F.col("y.x").rlike(f"^{INTEGER}$"))
    return rows.select("doc_id", "pos", F.get(R.number_terms(F.col("y.x"), F.col("y.b"), F.col("y.f")), F.lit(0)).alias("term"))


@query("select doc_id, regexp_replace(text, '[^\\x{00}-\\x{FF}\\x{100}-\\x{24F}\\x{1E00}-\\x{1EFF}\\x{2019}]', '', 'g') as kept from documents")
def charset_filter(spark, d):
    return storage.spread(_table(spark, d, "documents")).select("doc_id", R.keep_latin(F.col("text")).alias("kept"))


#: A page as a post: its address twice in the text, and in a map of short to long addresses, an empty one, or none.
SQL_POSTS = "posts as (select page_id, 'a ' || url || ' b http://x.y/z' as text, case page_id % 3 when 0 then '{}' when 1 then '{\"https://t.co/a\":\"' || url || '\",\"k\":null}' end as urls from pages)"


def _posts(spark, d) -> DataFrame:
    urls = F.when(F.col("page_id") % 3 == 0, "{}").when(F.col("page_id") % 3 == 1, F.concat(F.lit('{"https://t.co/a":"'), "url", F.lit('","k":null}')))
    return _table(spark, d, "pages").select("page_id", F.concat(F.lit("a "), "url", F.lit(" b http://x.y/z")).alias("text"), urls.alias("urls"))


@query(f"with {SQL_POSTS}, k as (select page_id, unnest(json_keys(urls)) as k, urls from posts where urls is not null), u as (select page_id, coalesce(json_extract_string(urls, '$.\"' || k || '\"'), k) as url from k union select page_id, regexp_extract(text, 'https?://\\S+') from posts where urls = '{{}}' and regexp_matches(text, 'https?://')) select page_id, url from u")
def url_extract(spark, d):
    return _posts(spark, d).select("page_id", F.explode(U.post_urls(F.col("text"), F.col("urls"))).alias("url"))


@query("with p as (select page_id, unnest(list_filter(regexp_extract_all(url, '[\\w''|.-]+'), lambda x: contains(x, 'www.'))) as piece from pages), q as (select page_id, string_split(piece, '.')[2] as name from p) select page_id, case when regexp_full_match(name, '\\p{L}+') then case when regexp_matches(name, '^[A-Z]') then upper(name) else lower(name) end else name end as domain from q where name <> '' and not contains(name, 'http') and name not in ('twitter.com', 'web', 'status', 'i')")
def url_domain_terms(spark, d):
    return _table(spark, d, "pages").select("page_id", F.explode(U.domain_terms(F.array("url"))).alias("domain"))


TURNS = "t as (select conv_id, turn, text as a, lead(text) over (partition by conv_id order by turn, text) as rq, case when turn % 2 = 0 then lead(text, 2) over (partition by conv_id order by turn, text) else lead(text) over (partition by conv_id order by turn, text) end as q from conversations)"


@query(f"with {TURNS} select conv_id, turn, a || case when rq is not null then ' ' || rq else '' end || case when q is not null and q is distinct from rq then ' ' || q else '' end as text from t")
def concat_text(spark, d):
    """A turn as a post that quotes the turns after it; at a conversation's end there are none."""
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    rq = F.lead("text").over(w)
    t = _table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("a"), rq.alias("rq"), F.when(F.col("turn") % 2 == 0, F.lead("text", 2).over(w)).otherwise(rq).alias("q"))
    return t.select("conv_id", "turn", U.concat_post(F.col("a"), F.col("rq"), F.col("q")).alias("text"))


@query("select event_id, json_extract_string(props, '$.k') as k, len(json_keys(props))::int as n_keys from events")
def json_url_map(spark, d):
    m = U.url_map(F.col("props"))
    return _table(spark, d, "events").select("event_id", m["k"].alias("k"), F.size(m).alias("n_keys"))


@query("with t as (select event_id, case when event_id % 5 > 0 then props end as s from events) select event_id, len(regexp_extract_all(coalesce(s, ''), '\\d+'))::int as n, coalesce(list_sum(list_transform(regexp_extract_all(coalesce(s, ''), '\\d+'), lambda x: x::int)), 0)::bigint as total from t")
def index_array_parse(spark, d):
    """Integers of a text field; a fifth of the fields is null."""
    a = U.int_list(F.when(F.col("event_id") % 5 > 0, F.col("props")))
    return _table(spark, d, "events").select("event_id", F.size(a).alias("n"), F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y).alias("total"))


@query("with t as (select event_id, case when event_id % 50 = 0 then 'bad date' when event_id % 7 > 0 then strftime(ts, '%a %b %d %H:%M:%S +0000 %Y') end as s from events) select event_id, date_diff('second', try_strptime(substr(s, 5), '%b %d %H:%M:%S +0000 %Y'), timestamp '2030-07-23 12:20:42') // 60 as minutes from t")
def post_age(spark, d):
    """Age of events by their time as a post writes it; some are null, some no dates."""
    t = F.col("ts").cast("timestamp_ntz")
    s = F.when(F.col("event_id") % 50 == 0, "bad date").when(F.col("event_id") % 7 > 0, F.concat(F.date_format(t, "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format(t, "yyyy")))
    return _table(spark, d, "events").select("event_id", age_minutes(post_time(s), F.lit("2030-07-23 12:20:42+00:00").cast("timestamp")).alias("minutes"))


@query("with t as (select unnest([item_id || '.' || x, x, item_id || ' ' || x || '.', '']) as value from (select item_id, regexp_replace(text, '[\\r\\n]+', ' ', 'g') as x from benchmark)) select try_cast(regexp_extract(value, '^([^.]*)\\.', 1) as bigint) as query_num, regexp_extract(value, '^[^.]*\\.(.*)$', 1) as text, not contains(value, '.') as malformed from t where value <> ''")
def query_file_parse(spark, d):
    """Query lines with a number, without one, with a dot elsewhere, and blank."""
    x = F.regexp_replace("text", r"[\r\n]+", " ")
    n = F.col("item_id").cast("string")
    lines = _table(spark, d, "benchmark").select(F.explode(F.array(F.concat(n, F.lit("."), x), x, F.concat(n, F.lit(" "), x, F.lit(".")), F.lit(""))).alias("value"))
    return sources.parse_query_lines(lines)


# ---------------------------------------------------------------- the parser's branches, in order, over tokens between blanks

_CAPITAL = "case when upper(left({0}, 1)) = left({0}, 1) and lower(left({0}, 1)) <> left({0}, 1) then upper(replace({0}, 'ß', 'SS')) else lower({0}) end"
_HAS_LETTER = "regexp_matches({0}, '\\p{{L}}')"
_DATE = "(not " + _HAS_LETTER + " and regexp_matches({0}, " + _lit(DATE).replace("{", "{{").replace("}", "}}") + "))"
#: NUM_TERM of a number s with value x, between words b and f in lower case: also of decimals, and of what is no number.
_ANY_NUMBER = (
    f"num0 as (select *, regexp_replace(joined, '[^-?\\p{{Nd}}./]', '', 'g') as s from nums), num1 as (select *, length(s) - length(replace(s, '.', '')) as dots, try_cast(s as double) as x from num0), "
    f"num2 as (select *, case when dots = 0 then coalesce(try_cast(s as decimal(38,0))::varchar, s) else {NUM_FMT.format('x')} end as plain, {NUM_CASES.replace(' a ', ' b ')} as sb, {NUM_CASES.replace(' a ', ' f ')} as sf from num1), "
    f"num as (select key, pos, case when contains(joined, '-') then joined when dots > 1 or x is null then s else {NUM_TERM} end as term from num2)"
)
SQL_TOKENS = (
    "texts as (select doc_id, text from documents union all select -1 - page_id, '@ Someone # ' || url || ' ' || url || ' 🙂 ''quoted -5 ' || html from pages), "
    f"raw as (select doc_id as key, list_filter(regexp_extract_all(text, {_lit(BLANK_TOKEN)}), lambda x: x not in {STOPS}) as a from texts), one as (select key, unnest(a) as t, generate_subscripts(a, 1) as i, len(a) as n from raw), "
    "mk as (select *, regexp_matches(t, '^[@#]') as mark, lead(t) over (partition by key order by i) as nxt from one), isl as (select *, i - row_number() over (partition by key, mark order by i) as island from mk), "
    "par as (select *, mark and (row_number() over (partition by key, mark, island order by i) - 1) % 2 = 0 as takes from isl), tk as (select *, coalesce(lag(takes) over (partition by key order by i), false) as taken from par), "
    "x as (select key, t, nxt, case when takes and i < n then 'A' when takes then 'M' else '.' end as flag, row_number() over (partition by key order by i) - 1 as pos from tk where not taken), "
    "nb as (select *, coalesce(lower(lag(t) over (partition by key order by pos)), '') as b, coalesce(lower(lead(t) over (partition by key order by pos)), '') as f, substr(t, 2) as rest, contains(t, '-') and t not like '-%' as hyphen from x), "
    f"tc as (select *, not hyphen and regexp_matches(t, {_lit(EMOJI)}) as emoji, t in ('twitter.com', 'web', 'status', 'i') as skip, case when hyphen then t when left(t, 1) in ('''', '-') then rest when t like '%.' then left(t, length(t) - 1) else t end as cut, {_DATE.format('t')} as dated, "
    f"case when {_HAS_LETTER.format('t')} or hyphen then '' else array_to_string(regexp_extract_all(t, {_lit(NUMBER)}), '') end as joined, regexp_full_match(t, '[A-Za-z\\x{{C0}}-\\x{{D6}}\\x{{D8}}-\\x{{F6}}\\x{{F8}}-\\x{{24F}}]+') as latin from nb), "
    "nums as (select key, pos, joined, b, f from tc where joined <> ''), " + _ANY_NUMBER + ", "
    "br as (select tc.*, case when skip or emoji then [] when flag = 'A' and left(t, 1) = '@' then [] "
    "when flag = 'A' then list_transform(regexp_extract_all(string_split(rest || nxt, '#')[1], '[A-Z]*[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9_-]+'), lambda p: lower(p)) when dated then [cut] when joined <> '' then [num.term] "
    "else (case when hyphen then case when len(list_filter(string_split(t, '-'), lambda p: regexp_full_match(p, '\\p{L}+'))) > 0 then list_transform(list_filter(string_split(t, '-'), lambda p: p <> ''), lambda p: lower(p)) else [t] end "
    f"when left(t, 1) in ('''', '-') or t like '%.' then [] when regexp_full_match(t, '\\p{{L}}+') then [{_CAPITAL.format('t')}] else [] end) "
    "|| (case when contains(cut, '/') and not contains(cut, '//t') then list_filter(string_split(cut, '/'), lambda p: length(p) > 1) else [] end) end as terms from tc left join num on num.key = tc.key and num.pos = tc.pos), "
    f"ch as (select key, pos, case when flag = '.' and latin and not skip then [{_CAPITAL.format('t')}] when len(terms) > 0 then terms when emoji or skip or contains(cut, '//t') or cut in ({', '.join(map(_lit, PUNCTUATION))}) or cut in {STOPS} or not regexp_full_match(cut, '[\\x21-\\x7F]*') then [] else [lower(cut)] end as terms, "
    f"regexp_matches(t, '\\p{{Nd}}') and not {_HAS_LETTER.format('t')} and not dated as is_number from br), "
    f"k as (select key as doc_id, pos, t as token, case when lower(t) = t then null when {IS_TITLE.format('t')} then case when regexp_full_match(t, '\\p{{L}}+') then 'A' else 'T' end "
    f"when contains(t, '-') and {IS_TITLE.format(HEAD.replace('token', 't'))} and {IS_TITLE.format(TAIL.replace('token', 't'))} then 'T' end as kind from x), "
    + ENTITY[ENTITY.index("i as (select *, pos - row_number()"):].replace("min(pos) - 1 as pos", "min(pos) as pos")
)


@query("with " + SQL_TOKENS + ", w as (select key as doc_id, pos, unnest(terms) as term, false as is_entity, is_number from ch) select doc_id, pos::int as pos, term, is_entity, is_number from w where term not in ('twitter.com', 'web', 'status', 'i', '') union all select doc_id, pos::int, entity, true, false from e")
def parsed_tokens_all(spark, d):
    """Terms of all tokens between blanks, of documents and of pages written as posts, through every branch of the parser in its order: hyphens, marks, dates, numbers, strips, slashes and the fallback."""
    pages = _table(spark, d, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.concat(F.lit("@ Someone # "), "url", F.lit(" "), "url", F.lit(" 🙂 'quoted -5 "), "html").alias("text"))
    docs = storage.spread(_table(spark, d, "documents").select("doc_id", "text").unionAll(pages))
    return parse.parse(docs, stem=False, tokenizer=_blank_tokens).select("doc_id", "pos", "term", "is_entity", "is_number")


# ---------------------------------------------------------------- the whole engine
# SQL has no stemmer and no Treebank tokens, so it follows the engine with tokens of letters or digits and without stems:
# stop words, capital forms, numbers by the words beside them, entities, folding by case, pruning, correction and ranking.

ENGINE = {"tokenizer": lambda text: R.simple_tokens(text, "[A-Za-z]+|[0-9]+", lower=False)}
SKIP = "('twitter.com', 'web', 'status', 'i', '')"


def _sql_parse(key: str, table: str, p: str) -> str:
    """CTE {p}all(key, pos, term, is_entity, is_number): what parse() gives of a table's texts."""
    return (
        f"{p}raw as (select {key} as key, regexp_extract_all(text, '[A-Za-z]+|[0-9]+') as a from {table}), {p}one as (select key, unnest(a) as token, generate_subscripts(a, 1) as i from {p}raw), "
        f"{p}kept as (select key, token, row_number() over (partition by key order by i) - 1 as pos, coalesce(lower(lag(token) over (partition by key order by i)), '') as b, coalesce(lower(lead(token) over (partition by key order by i)), '') as f from {p}one where token not in {STOPS}), "
        f"{p}num as (with m as (select *, token as s, token::double as x from {p}kept where regexp_matches(token, '^[0-9]')), {NUM_STEPS} select key, pos, {NUM_TERM} as term from c), "
        f"{p}title as (select *, pos - row_number() over (partition by key order by pos) as island from {p}kept where regexp_full_match(token, '[A-Z][a-z]*')), "
        f"{p}all as (select key, pos, case when regexp_matches(token, '^[A-Z]') then upper(token) else lower(token) end as term, false as is_entity, false as is_number from {p}kept where regexp_matches(token, '^[A-Za-z]') and token not in {SKIP} "
        f"union all select key, pos, term, false, true from {p}num "
        f"union all select key, min(pos), string_agg(token, ' ' order by pos), true, false from {p}title group by key, island having count(*) >= 2)"
    )


SQL_INDEX = (
    _sql_parse("doc_id", "documents", "d") + ", terms as (select * from dall where term not in " + SKIP + "), "
    "ents as (select term from terms where is_entity group by term having count(*) >= 2), lows as (select distinct term from terms), "
    "folded as (select key as doc_id, case when not is_entity and t.term = upper(t.term) and t.term <> lower(t.term) and lows.term is not null then lows.term else t.term end as term, is_number from terms t left join lows on lows.term = lower(t.term) where not is_entity or t.term in (select term from ents)), "
    "tf as (select doc_id, term, count(*) as tf, sum(is_number::int) as numbers from folded group by doc_id, term), "
    "freq as (select *, max(tf) over (partition by doc_id) as max_tf, tf / max(tf) over (partition by doc_id) as ntf from tf), voc as (select term, count(*) as df from tf group by term having count(*) > 1)"
)
SQL_ASKED = _sql_parse("item_id", "benchmark", "q") + ", asked as (select key as query_num, term from qall where term not in " + SKIP + ")"
SQL_FIXED = (
    SQL_ASKED + ", " + FOUND.replace("from qtok", "from asked") + ", qtok as (select asked.query_num, coalesce(e.term, a.term, best.candidate, asked.term) as term from asked left join voc e on e.term = asked.term "
    "left join voc a on a.term = case when upper(asked.term) = asked.term then lower(asked.term) when lower(asked.term) = asked.term then upper(asked.term) end left join best on best.term = asked.term)"
)


def _corpus(spark, d) -> DataFrame:
    """Documents with their latest dates. One date an id, so what asks for no dates leaves the join out: texts are not shuffled."""
    dates = _dates(spark, d).groupBy("doc_id").agg(F.max("created_at").alias("created_at"))
    return storage.spread(_table(spark, d, "documents").select("doc_id", "text")).join(dates, "doc_id", "left")


def _questions(spark, d) -> DataFrame:
    return _table(spark, d, "benchmark").select(F.col("item_id").alias("query_num"), "text")


@query("with " + _sql_parse("doc_id", "documents", "d") + f" select key as doc_id, pos::int as pos, term, is_entity, is_number from dall where term not in {SKIP}")
def parsed_terms(spark, d):
    return parse.parse(storage.spread(_table(spark, d, "documents")), stem=False, **ENGINE).select("doc_id", "pos", "term", "is_entity", "is_number")


@query(f"with {SQL_INDEX} select f.term, f.doc_id, f.tf, round(f.ntf, 9) as ntf from freq f join voc on voc.term = f.term")
def engine_index(spark, d):
    return engine.build_index(_corpus(spark, d), stem=False, **ENGINE).postings.withColumn("ntf", F.round("ntf", 9))


@query(f"with {SQL_INDEX}, n as (select key as doc_id, count(*)::int as doc_length from dkept group by key) select freq.doc_id, any_value(doc_length) as doc_length, max(tf) as max_tf, max(ts) as created_at from freq join n on n.doc_id = freq.doc_id left join events on event_id = freq.doc_id group by freq.doc_id")
def engine_documents(spark, d):
    return engine.build_index(_corpus(spark, d), stem=False, **ENGINE).doc_stats


@query(f"with {SQL_INDEX} select (select count(*) from documents) as n_docs, (select sum(numbers) from freq)::bigint as n_numbers, (select count(*) from voc) as n_terms, (select count(*) from freq join voc on voc.term = freq.term) as n_postings")
def engine_stats(spark, d):
    ix = engine.build_index(_corpus(spark, d), stem=False, **ENGINE)
    # one row by one row
    return ix.stats.select("n_docs", "n_numbers").crossJoin(ix.vocabulary.agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("n_postings")))


@query(f"with {SQL_INDEX}, {SQL_FIXED}, {WEIGHTS}, {SCORES} {RANKED}")
def engine_search(spark, d):
    folder = storage.new_folder(spark)
    storage.save(engine.build_index(_corpus(spark, d), stem=False, **ENGINE), folder)
    return engine.search(storage.load(spark, folder), _questions(spark, d), K, **ENGINE)


@query()
def treebank_terms(spark, d):
    """Stemmed terms of Treebank tokens, the default."""
    return parse.parse(storage.spread(_table(spark, d, "documents")))


@query(f"with {TF}, words as (select distinct term from tf), {stem_sql('words')} select stem as term, count(distinct doc_id) as df from tf join stemmed on stemmed.term = tf.term group by stem having count(distinct doc_id) > 1")
def stemmed_vocabulary(spark, d):
    freq = storage.written(_freq(spark, d))
    stems = storage.written(stem_vocabulary(index.vocabulary(freq).withColumn("stem", F.col("term")), "stem"))
    return index.merged_vocabulary(freq.select("doc_id", "term"), stems, "stem", 2)


@query()
def treebank_search(spark, d):
    """The engine as it is by default, with Treebank tokens and stems."""
    folder = storage.new_folder(spark)
    storage.save(engine.build_index(_corpus(spark, d)), folder)
    return engine.search(storage.load(spark, folder), _questions(spark, d), K)


@query()
def lsi_search(spark, d):
    """Nearest documents of all queries in the latent space of a saved index, which is saved and opened again."""
    folder = storage.new_folder(spark)
    built = engine.build_index(_corpus(spark, d), stem=False, **ENGINE)
    storage.save(built, folder)
    # the index that was built still has its rows by document
    lsi.save_space(lsi.decompose(built), storage.load(spark, folder), f"{folder}/space")
    weights = rank.query_weights(engine.parse_queries(_questions(spark, d), stem=False, **ENGINE))
    return lsi.search(lsi.load_space(spark, f"{folder}/space"), weights, K).select("query_num", "doc_id", F.round("score", 6).alias("score"), "rnk")


@query(f"with {VOC}, {BROKEN}, {FOUND} select term, candidate, df from cand")
def stored_spell_candidates(spark, d):
    """Corrections of broken queries from an index's saved deletions, by a filter that reaches their scan."""
    freq, vocab = _counted(spark, d)
    stats = _table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n_docs"))
    folder = storage.new_folder(spark)
    storage.save(storage.Index(vocab, index.postings(freq, vocab), _dates(spark, d), stats, frequencies=freq), folder)
    ix = storage.load(spark, folder)
    return correct.spell_candidates(correct.unknown_terms(_broken(spark, d), ix.vocabulary), ix.vocabulary, ix.deletions)


@query(f"with {SQL_INDEX} select f.term, f.doc_id, f.tf, round(f.ntf, 9) as ntf from freq f join voc on voc.term = f.term")
def grown_index(spark, d):
    """Postings of an index that grew by four batches of the documents, two of them compacted: those of the whole."""
    folder = storage.new_folder(spark)
    docs = _table(spark, d, "documents").select("doc_id", "text")
    for k in range(4):
        append.write_batch(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == k), k, folder, stem=False, **ENGINE)
        if k == 1:
            append.compact(spark, folder)
    return append.read_index(spark, folder).postings.withColumn("ntf", F.round("ntf", 9))


@query(f"with {VOC} select f.term, f.doc_id, f.tf, round(f.ntf, 9) as ntf from freq f join voc on voc.term = f.term where f.term in (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) from benchmark)")
def index_lookup(spark, d):
    """Postings of the queries' terms, from an index that was saved and opened again."""
    freq, vocab = _counted(spark, d)
    stats = _table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n_docs"))
    folder = storage.new_folder(spark)
    storage.save(storage.Index(vocab, index.postings(freq, vocab), _dates(spark, d), stats, frequencies=freq), folder)
    return storage.lookup(storage.load(spark, folder), _asked(spark, d)).select("term", "doc_id", "tf", F.round("ntf", 9).alias("ntf"))


# ---------------------------------------------------------------- posting lists in blocks


def _blocked(spark, d) -> storage.Index:
    """The index with its lists in blocks, saved and opened again; several buckets already at small sizes."""
    folder = storage.new_folder(spark)
    storage.save(engine.build_index(_corpus(spark, d), stem=False, **ENGINE), folder, postings_per_file=200_000, in_blocks=True)
    return storage.load(spark, folder)


@query(f"with {SQL_INDEX} select f.term, f.doc_id, f.tf, round(f.ntf, 9) as ntf from freq f join voc on voc.term = f.term")
def blocked_postings(spark, d):
    """What all blocks unfold to: the index's postings."""
    return _blocked(spark, d).postings.withColumn("ntf", F.round("ntf", 9))


@query(f"with {SQL_INDEX}, {SQL_FIXED}, {WEIGHTS}, {SCORES} {RANKED}")
def blocked_search(spark, d):
    """Ranked search over lists in blocks."""
    return engine.search(_blocked(spark, d), _questions(spark, d), K, **ENGINE)


@query(f"with {SQL_INDEX}, b as (select f.*, row_number() over (partition by f.term order by f.ntf desc, f.doc_id) as rnk from freq f join voc on voc.term = f.term) select term, doc_id, tf, round(ntf, 9) as ntf, rnk::int as rnk from b where rnk <= {K}")
def champion_postings(spark, d):
    """Each term's postings of highest normalised frequency; blocks whose bound is too low are not unfolded."""
    return blocks.best(_blocked(spark, d).blocks.rows, K).withColumn("ntf", F.round("ntf", 9))
