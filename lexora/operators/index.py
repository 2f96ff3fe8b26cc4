"""The inverted index as ordinary rows: term frequencies, vocabulary, postings, document statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import held, run_starts, runs
from ..functions.rules import capital_form, simple_tokens
from ..functions.stem import stem_vocabulary
from ..functions.words import SKIPPED
from ..plans.storage import spread, written
from .joins import join_terms, small


def simple_terms(docs: DataFrame, key: str = "doc_id", text: str = "text", pattern: str = "[a-z]+", lower: bool = True) -> DataFrame:
    """key, pos, term: the matches of a pattern."""
    return docs.select(key, F.posexplode(simple_tokens(F.col(text), pattern, lower)).alias("pos", "term"))


def has_repeats(docs: DataFrame, key: str = "doc_id") -> bool:
    """Whether any two rows share a key. Reads the key column alone."""
    return docs.groupBy(key).count().where("count > 1").limit(1).count() > 0


def term_frequencies(docs: DataFrame, tokens: Column, key: str = "doc_id", positions: bool = False) -> DataFrame:
    """key, term, tf, max_tf, ntf (and positions) of ``docs``, one row a document and term.

    A document's tokens are sorted and counted inside its row, so nothing is shuffled. Rows that
    share a key are one document: only where there are any are the counts added up by an exchange
    (their positions follow each row's own).
    """
    if positions:
        source = F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("p"))))
        value = lambda x: x["t"]
    else:
        source, value = F.sort_array(tokens), lambda x: x
    t = spread(docs).select(key, F.explode(F.array(source)).alias("t"))
    t = held(t, "s", run_starts("t", value))
    # a run takes its own places with it: a text's words must not go with each of its terms
    t = held(t, "r", runs("t", "s", value, lambda x: x["p"]) if positions else runs("t", "s")).withColumn("max_tf", F.array_max(F.transform("r", lambda r: r["tf"])).cast("long"))
    more = [F.col("x.items").alias("positions")] if positions else []
    out = t.select(key, "max_tf", F.explode("r").alias("x")).select(key, F.col("x.term").alias("term"), F.col("x.tf").cast("long").alias("tf"), "max_tf", *more)
    if has_repeats(docs, key):
        added = [F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions")] if positions else []
        out = top_frequencies(out.repartition(key).groupBy(key, "term").agg(F.sum("tf").alias("tf"), *added), key)
        return out
    return out.withColumn("ntf", F.col("tf") / F.col("max_tf"))


def top_frequencies(freq: DataFrame, key: str = "doc_id") -> DataFrame:
    """freq(key, term, tf, ...) with max_tf and ntf. Rows that lie by key already are not dealt again."""
    top = F.max("tf").over(Window.partitionBy(key))
    return freq.withColumn("max_tf", top).withColumn("ntf", F.col("tf") / F.col("max_tf"))


def vocabulary(doc_terms: DataFrame, least: int = 1) -> DataFrame:
    """term, df: of terms in at least ``least`` documents."""
    return doc_terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)


def postings(doc_terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """term, doc_id, tf, ntf of the vocabulary's terms. Both should be written tables."""
    return join_terms(doc_terms.select("term", "doc_id", "tf", "ntf"), vocab.select("term", "df"), ["term"], "df").select("term", "doc_id", "tf", "ntf")


#: Rows of a term up to which they lie in one task.
HOT_ROWS = 5_000_000


def ordered_postings(doc_terms: DataFrame, vocab: DataFrame, least: int, hot: int = HOT_ROWS) -> list[DataFrame]:
    """postings() of terms in at least ``least`` documents, by ranges of terms and in order, of one exchange and no join: a term's rows lie together, and are counted there.

    Terms of more than ``hot`` rows, which the vocabulary tells, are dealt by document too, in a frame of their own. Both should be written tables.
    """
    often = [r["term"] for r in vocab.where(F.col("df") > hot).select("term").collect()]
    rows, df = doc_terms.select("term", "doc_id", "tf", "ntf"), F.count(F.lit(1)).over(Window.partitionBy("term"))
    rest = rows.where(~F.col("term").isin(often)) if often else rows
    out = [rest.repartitionByRange("term").sortWithinPartitions("term", "doc_id").withColumn("__df", df).where(F.col("__df") >= least).drop("__df")]
    return out + [rows.where(F.col("term").isin(often)).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")] * bool(often)


def doc_stats(doc_terms: DataFrame, lengths: DataFrame, created: DataFrame | None = None) -> DataFrame:
    """doc_id, doc_length, max_tf (and created_at) of documents with a term."""
    out = doc_terms.groupBy("doc_id").agg(F.max("max_tf").alias("max_tf")).join(lengths, "doc_id", "left")
    return out if created is None else out.join(created, "doc_id", "left")


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


def fold_case(forms: DataFrame) -> DataFrame:
    """A vocabulary ``forms(term, ...[, kind])`` with ``folded``: the lower form of an all-upper term wherever the vocabulary has it, else the term.

    The vocabulary is folded and not the corpus: what it counts is added up after it is joined. Entities (kind 'e') stay.
    """
    may = is_upper(F.col("term")) & (F.col("kind") != "e") if "kind" in forms.columns else is_upper(F.col("term"))
    low = forms.select(F.col("term").alias("__low")).distinct()
    fold = forms.where(may).select(F.col("term").alias("__up")).distinct().join(low, F.lower("__up") == F.col("__low"))
    out = forms.join(fold, F.col("term") == F.col("__up"), "left")
    return out.withColumn("folded", F.when(may & F.col("__low").isNotNull(), F.col("__low")).otherwise(F.col("term"))).drop("__up", "__low")


#: Follows the lower form of a token in capitals: sorted, the two stand side by side.
CAPITAL = "\u0001"


def folded_vocabulary(docs: DataFrame, tokens: Column, key: str = "doc_id") -> DataFrame:
    """term, df, tf of tokens of letters A-Z: fold_case() of their capital forms, by one exchange of sums.

    A document's forms are counted inside its row, where one in capitals stands beside its lower form, so a document that
    has both is known there and counts once; the corpus's sums tell whether there is a lower form to fold to. Only where
    rows share a key are they added up by an exchange first.
    """
    first = lambda t: F.substring(t, 1, 1)
    marked = lambda t: F.when(F.lower(t) == t, t).when(F.lower(first(t)) == first(t), F.lower(t)).otherwise(F.concat(F.lower(t), F.lit(CAPITAL)))
    t = spread(docs).select(key, F.explode(F.array(F.sort_array(F.transform(tokens, marked)))).alias("t"))
    t = held(held(t, "s", run_starts("t")), "r", runs("t", "s"))
    beside = F.transform("r", lambda x, k: F.struct(x["term"].alias("form"), x["tf"].cast("long").alias("tf"), F.get(F.col("r"), k - 1)["term"].alias("before")))
    rows = t.select(key, F.explode(beside).alias("x")).select(key, "x.*")
    capital = F.col("form").endswith(CAPITAL)
    rows = rows.withColumn("term", F.when(capital, F.left("form", F.length("form") - 1)).otherwise(F.col("form")))
    both = F.coalesce(capital & (F.col("before") == F.col("term")), F.lit(False))
    rows = rows.select(key, "term", F.when(both, 0).otherwise(1).alias("df"), "tf", (~capital).alias("low"))
    if has_repeats(docs, key):
        rows = rows.groupBy(key, "term").agg(F.lit(1).alias("df"), F.sum("tf").alias("tf"), F.max("low").alias("low"))
    sums = rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"), F.max("low").alias("low"))
    return sums.select(F.when(F.col("low"), F.col("term")).otherwise(F.upper("term")).alias("term"), "df", "tf")


def merged_vocabulary(doc_terms: DataFrame, names: DataFrame, name: str, least: int = 1) -> DataFrame:
    """term, df: of ``names(term, df, <name>)``, a vocabulary whose terms share names, in documents; both should be written tables.

    A name of one term has its df. Only the others' rows meet the vocabulary, to count a document once.
    """
    sized = written(names.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(name))))
    alone = sized.where("__n = 1").select(F.col(name).alias("term"), "df")
    shared = join_terms(doc_terms, sized.where("__n > 1").select("term", name, "df"), ["term"], "df").select("doc_id", F.col(name).alias("term")).distinct()
    return alone.unionByName(vocabulary(shared)).where(F.col("df") >= least)


def moves(c: Column, kind: Column) -> Column:
    """Whether folding by case or pruning of entities may change a form or leave it out."""
    return is_upper(c) | (kind == "e")


def canonical_forms(counts: DataFrame, stem: bool, least_entity: int = 2) -> DataFrame:
    """form, kind, term, n: the term of each form that ``counts(form, kind, tf)`` holds, stemmed if asked and folded by case. Without stems, of forms that may change alone.

    Stems are taken once a form, not once a token; URL terms are not stemmed. Entities that occur
    fewer than ``least_entity`` times are left out.
    """
    v = counts.groupBy("form", "kind").agg(F.sum("tf").alias("n")).where((F.col("kind") != "e") | (F.col("n") >= least_entity))
    if not stem:
        v = written(v)
        some = v.where(moves(F.col("form"), F.col("kind"))).withColumn("__low", F.when(F.col("kind") != "e", F.lower("form")))
        found = some.select("__low").distinct().join(v.select(F.col("form").alias("__low")), "__low", "left_semi").withColumn("__found", F.col("__low"))
        return written(some.join(found, "__low", "left").select("form", "kind", F.coalesce("__found", "form").alias("term"), "n"))
    # plain words may come as they stand
    v = v.withColumn("term", F.when(F.col("kind") == "t", capital_form(F.col("form"))).otherwise(F.col("form"))).where((F.col("kind") != "t") | ~F.col("term").isin(SKIPPED))
    v = v.repartition(v.sparkSession.sparkContext.defaultParallelism, "form")  # stemming is the work: every core takes part
    v = stem_vocabulary(v.withColumn("to_stem", F.when(F.col("kind") != "u", F.col("term"))), "to_stem").withColumn("term", F.coalesce("to_stem", "term")).drop("to_stem")
    return written(fold_case(written(v)).select("form", "kind", F.col("folded").alias("term"), "n"))


def unsure_documents(counts: DataFrame) -> DataFrame:
    """doc_id of documents that are of several texts, or whose terms their text alone does not tell."""
    found = counts.where(F.col("head") | F.col("top").isNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("top").isNull()).alias("doubt"))
    return found.where((F.col("n") > 1) | F.col("doubt")).select("doc_id")


def index_frequencies(counts: DataFrame, forms: DataFrame, stem: bool = True) -> DataFrame:
    """doc_id, term, tf, max_tf, ntf, numbers, doc_length of parse_counts() rows and their canonical forms.

    Without stems only forms in capitals and entities may change or go: the others are their own terms and meet no vocabulary. A
    document of one text has its sums from its own row, so its rows are not dealt by document; other documents, and stems, take one exchange.
    """
    if stem or "top" not in counts.columns:
        return _dealt_frequencies(counts, forms, stem)
    unsure = written(unsure_documents(counts))
    some = bool(unsure.limit(1).count())
    sure = counts.join(small(unsure), "doc_id", "left_anti") if some else counts
    columns = lambda df, term, tf, numbers: df.select("doc_id", term.alias("term"), tf.alias("tf"), numbers.alias("numbers"), "doc_length", F.col("top").alias("max_tf"))
    own = moves(F.col("form"), F.col("kind"))
    stay = columns(sure.where(~own), F.col("form"), F.col("tf") + F.col("more"), F.col("numbers") + F.col("more_numbers"))
    move = columns(join_terms(sure.where(own & ~F.col("low")), forms, ["form", "kind"], "n"), F.col("term"), F.col("tf"), F.col("numbers"))
    out = stay.unionByName(move).withColumn("ntf", F.col("tf") / F.col("max_tf"))
    return out.unionByName(_dealt_frequencies(counts.join(small(unsure), "doc_id", "left_semi"), forms, stem)) if some else out


def _dealt_frequencies(counts: DataFrame, forms: DataFrame, stem: bool) -> DataFrame:
    """index_frequencies() of any rows, by one exchange by document."""
    wanted = lambda df: df.select("doc_id", "term", "tf", "numbers", "doc_length")
    if stem:
        rows = wanted(join_terms(counts, forms, ["form", "kind"], "n"))
    else:
        own = moves(F.col("form"), F.col("kind"))
        rows = wanted(join_terms(counts.where(own), forms.where(own), ["form", "kind"], "n")).unionByName(wanted(counts.where(~own).withColumn("term", F.col("form"))))
    merged = rows.repartition(F.col("doc_id")).groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"), F.sum("numbers").alias("numbers"), F.max("doc_length").alias("doc_length"))
    return top_frequencies(merged)


def prune_entities(terms: DataFrame, least: int = 2) -> DataFrame:
    """terms without entities that occur fewer than ``least`` times in the corpus."""
    often = terms.where("is_entity").groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("term")
    return terms.where(~F.col("is_entity")).unionByName(terms.where("is_entity").join(often, "term", "left_semi").select(*terms.columns))


def ordinals(keys: DataFrame, column: str, name: str = "id") -> DataFrame:
    """A dense number from 0 for each distinct key in its order: range partitions, written once, and counts of them."""
    dealt = written(keys.select(column).distinct().repartitionByRange(column).withColumn("part", F.spark_partition_id()))
    inner = Window.partitionBy("part").orderBy(column)
    ranked = dealt.withColumn("k", F.row_number().over(inner) - 1)
    before = dealt.groupBy("part").count().withColumn("before", F.sum("count").over(Window.orderBy("part")) - F.col("count")).select("part", "before")
    return ranked.join(F.broadcast(before), "part").select(column, (F.col("k") + F.col("before")).alias(name))
