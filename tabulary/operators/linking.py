"""Links between records: related, corrected, cited, circulars, alerts, takedowns, circulated dates."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulary.functions.gazette import find_references
from tabulary.functions.labels import circular_date, circular_title, parse_circular
from tabulary.functions.text import normalize
from tabulary.operators import search as S
from tabulary.operators.lists import earlier_match, first_per
from tabulary.sources.stored import kept


def without_takedowns(records: DataFrame, removed: DataFrame) -> DataFrame:
    """Records but those listed by (year, number, ref_type, ref_number)."""
    return records.join(removed, ["year", "number", "ref_type", "ref_number"], "left_anti")


def related_records(records: DataFrame) -> DataFrame:
    """(id, related_id): the council decision of the same issue and title that an unrelated notice has; the least id of several."""
    plain = records.select("id", "issue_id", "ref_type", "related_record_id", normalize(F.col("title")).alias("t"))
    notices = plain.where("ref_type = 'ae' and related_record_id is null").select("id", "issue_id", "t")
    decisions = plain.where("ref_type in ('uki', 'ukii')").groupBy("issue_id", "t").agg(F.min("id").alias("related_id"))
    return notices.join(decisions, ["issue_id", "t"]).select("id", "related_id")


def corrected_records(records: DataFrame) -> DataFrame:
    """(id, corrects_id): the latest earlier record of the same reference that an unlinked correction corrects."""
    rows = records.where("ref_type is not null and ref_number is not null").select("id", "ref_type", "ref_number", "published_at", "title", "corrects_id")
    fixes = rows.where(F.col("corrects_id").isNull() & F.upper(F.translate("title", "iı", "İI")).startswith("DÜZELTME"))
    found = earlier_match(fixes.select("id", "ref_type", "ref_number", "published_at"), rows.select("id", "ref_type", "ref_number", "published_at"), ["ref_type", "ref_number"], "published_at", "id")
    return found.where("source_id is not null").select("id", F.col("source_id").alias("corrects_id"))


def with_issue_dates(records: DataFrame, issues: DataFrame) -> DataFrame:
    """Records dated as their issue is; records without an issue keep their date."""
    dates = issues.select(F.col("id").alias("issue_id"), F.col("published_at").alias("__date"))
    joined = records.join(dates, "issue_id", "left").withColumn("published_at", F.coalesce("__date", "published_at"))
    return joined.select(records.columns)


def cited_records(records: DataFrame) -> DataFrame:
    """(id, cited_id): records whose primary references a title names, itself left out; one step, no chains."""
    named = records.withColumn("__r", find_references("title")).select("id", F.inline(F.filter("__r", lambda r: r["main"])))
    refs = named.select("id", F.col("type").alias("ref_type"), F.col("number").alias("ref_number"))
    known = records.where("ref_type is not null").select(F.col("id").alias("cited_id"), "ref_type", "ref_number")
    return refs.join(known, ["ref_type", "ref_number"]).where("id <> cited_id").select("id", "cited_id").distinct()


#: Fixed value: the categories of vacancies.
VACANCY_CATEGORY = "[iİ]lk-[aA]tama|[yY]ükselme|[öÖ]ğretmenlik"
_CANCELLED = r"(?i)\(\s*[İIi]ptal\s*\)"


def circular_candidates(rows: DataFrame) -> DataFrame:
    """(url, label, ref_type, ref_number, title, department, category, deadline, cancelled) of a listing's rows
    (row, circular, category, department, pdf_url, deadline_text).

    Left out are rows whose name is no circular's or of a series without records, without a file or a
    department, or of another category than vacancies. Of rows that list one circular again the first
    holds. A cancellation is a mark in the department's name, and is taken out of it; what stands after
    ``?`` in an address is no part of it. Circulars without a title are left out last.
    """
    named = rows.withColumn("c", parse_circular(F.col("circular"))).withColumn("url", F.split_part("pdf_url", F.lit("?"), F.lit(1)))
    good = named.where(F.col("c.ref_type").isNotNull() & (F.col("url") != "") & F.col("category").rlike(VACANCY_CATEGORY) & (F.col("department") != ""))
    first = first_per(good.withColumn("label", F.col("c.label")), ["label"], [F.col("row")])
    bare = F.trim(F.regexp_replace("department", _CANCELLED, ""))
    made = first.select("url", "label", "c.ref_type", "c.ref_number", circular_title(F.col("label"), bare, F.col("category")).alias("title"), bare.alias("department"), "category",
                        circular_date(F.col("deadline_text")).alias("deadline"), F.col("department").rlike(_CANCELLED).alias("cancelled"))
    return made.where("title is not null")


def circular_matches(circulars: DataFrame, records: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(keep, url, status, record_id): ``imported`` where a record came from the circular's page, else ``have`` where one
    record has its reference or names it at its head (column ``head``, if there is one), ``ambiguous`` where several
    do, else ``missing``.

    Names in heads are taken out once and joined like references, not tried one circular after another.
    """
    by_url = records.where("source_url is not null").groupBy(F.col("source_url").alias("url")).agg(F.min("id").alias("own"))
    known = records.where("ref_type is not null").select("ref_type", "ref_number", "id")
    if "head" in records.columns:
        names = F.regexp_extract_all("head", F.lit(r"(?i)(?<![A-Za-zÇĞİÖŞÜçğıöşü])((?:M[İIi]A|MT|[ÖO]|YD|Y)\.?\s*\d+[A-Z]?\s*/\s*\d{4})(?!\d)"), 1)
        named = records.select("id", F.explode(names).alias("n")).select("id", parse_circular(F.col("n")).alias("c"))
        known = known.unionByName(named.select("c.ref_type", "c.ref_number", "id").where("ref_type is not null")).distinct()
    by_ref = known.groupBy("ref_type", "ref_number").agg(F.min("id").alias("one"), F.count("*").alias("n"))
    joined = circulars.join(by_url, "url", "left").join(by_ref, ["ref_type", "ref_number"], "left")
    status = F.when(F.col("own").isNotNull(), "imported").when(F.col("n") == 1, "have").when(F.col("n") > 1, "ambiguous").otherwise("missing")
    return joined.select(*(keep or []), "url", status.alias("status"), F.when(status.isin("imported", "have"), F.coalesce("own", "one")).alias("record_id"))


#: Alerts from which on a condition counts as common; alerts that meet the hits of a common set at a time; records from which on a word is dealt out.
_COMMON, _DEALT, _HEAVY = 16, 256, 1 << 16


def alert_matches(alerts: DataFrame, records: DataFrame) -> DataFrame:
    """(alert_id, id): new records by topic, document type, entity or search text of each active alert.

    Alerts and records meet only in a value or word that both have; see ``text_matches``.
    """
    active = alerts.where("is_active")
    asked, had = [], []
    for wanted, have in (("topics", "topics"), ("doc_types", None), ("entity_ids", "entity_ids")):
        key = lambda v: F.concat(F.lit(f"{wanted}:"), F.col(v).cast("string")).alias("key")  # noqa: B023, E731
        asked.append(active.select("alert_id", F.explode(wanted).alias("v")).select("alert_id", key("v")))
        had.append(records.select("id", F.explode(F.array_distinct(have)).alias("v")).select("id", key("v")) if have else records.select("id", key("doc_type")))
    return _paired(asked, had, active if "query" in alerts.columns else None, records)


def text_matches(alerts: DataFrame, records: DataFrame) -> DataFrame:
    """(alert_id, id): records whose text satisfies an alert's query, read as plain words, phrases, OR and minus.

    Queries become clauses, and equal clauses are looked for once. A clause meets the records that
    have the word of it that fewest records have, and is then held against their texts. The empty
    word, which all records have, stands for clauses that only bar. Null texts are empty; blank
    queries match nothing.
    """
    return _paired([], [], alerts, records)


def _paired(asked: list[DataFrame], had: list[DataFrame], searching: DataFrame | None, records: DataFrame) -> DataFrame:
    """(alert_id, id) of alerts (alert_id, key) and records (id, key) that share a key, and of queries and texts.

    Each condition meets its records once. Conditions of few alerts are then spread over them. Of
    common ones each set that alerts have is met once, and its records go to all alerts that have
    it: those pairs, the bulk of them, need no comparing. Joins are no broadcasts, for
    stored tables are many times their files' size in memory.
    """
    if searching is not None:
        asked = [*asked, searching.select("alert_id", F.explode(_clauses("query")).alias("c")).select("alert_id", F.concat(F.lit("query:"), F.to_json("c")).alias("key"))]
    every = kept(reduce(DataFrame.unionByName, asked).where("key is not null").distinct(), "asked")
    conditions = kept(every.groupBy("key").agg(F.count("*").alias("owners")).withColumn("cond", F.monotonically_increasing_id()), "conditions")
    hits = [h.join(conditions.hint("merge"), "key").select("cond", "id") for h in had]
    if searching is not None:
        hits.append(_text_hits(conditions, records))
    hits = kept(reduce(DataFrame.unionByName, hits), "hits")
    owned = kept(every.join(conditions.hint("merge"), "key").select("alert_id", "cond", "owners"), "owned")
    few = owned.where(F.col("owners") <= _COMMON).join(hits.hint("merge"), "cond").select("alert_id", "id").distinct()
    sets = owned.where(F.col("owners") > _COMMON).groupBy("alert_id").agg(F.array_sort(F.collect_set("cond")).alias("conds"))
    named = sets.groupBy("conds").agg(F.min("alert_id").alias("set"), F.count("*").alias("members"))
    members = kept(sets.join(named.hint("merge"), "conds").select("alert_id", "set", "members", F.when(F.col("alert_id") == F.col("set"), F.col("conds")).alias("conds")), "members")
    shared = members.select("set", "members", F.explode("conds").alias("cond")).join(hits.hint("merge"), "cond").select("set", "members", "id").distinct()
    shared = kept(shared, "shared")
    few = few.join(members.select("alert_id", "set").hint("merge"), "alert_id", "left").join(shared.select("set", "id").hint("merge"), ["set", "id"], "left_anti")
    parts = F.ceil(F.col("members") / _DEALT)
    dealt = shared.select("set", "id", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    most = members.select("alert_id", "set", F.pmod(F.xxhash64("alert_id"), parts).alias("part")).join(dealt.hint("merge"), ["set", "part"])
    return few.select("alert_id", "id").unionByName(most.select("alert_id", "id"))


def _text_hits(conditions: DataFrame, records: DataFrame) -> DataFrame:
    """(cond, id): the records that satisfy each condition whose key is a clause."""
    clause = F.from_json(F.substring("key", 7, 1 << 30), _CLAUSE)
    clauses = conditions.where(F.col("key").startswith("query:")).select("cond", clause.alias("c"))
    texts = records.select("id", S.search_text(F.col("text")).alias("t"))
    has = texts.select("id", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.trim("t"), " ")))).alias("word"))
    counts = kept(has.groupBy("word").agg(F.count("*").alias("n")), "words")
    needs = clauses.select("cond", "c", F.explode(F.when(F.size("c.words") > 0, F.col("c.words")).otherwise(F.array(F.lit("")))).alias("word"))
    counted = needs.select("cond", "word").join(counts.hint("merge"), "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("cond").agg(F.min(F.struct("n", "word")).alias("first")).select("cond", "first.*").where("n > 0")
    firsts = kept(rarest.join(clauses.hint("merge"), "cond"), "firsts")
    # A word of very many records is dealt out, or left out if no clause begins with it; there are few of them.
    parts = F.ceil(F.col("n") / _HEAVY)
    sought = firsts.select("word").distinct().withColumn("sought", F.lit(True))
    heavy = counts.where(F.col("n") > _HEAVY).join(sought.hint("merge"), "word", "left").select("word", "sought", parts.alias("parts"))
    dealt = has.join(F.broadcast(heavy), "word", "left").where("parts is null or sought").select("id", "word", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).alias("part"))
    met = dealt.join(firsts.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).hint("merge"), ["word", "part"]).select("cond", "c", "id")
    held = lambda p: F.col("t").contains(F.concat(F.lit(" "), p, F.lit(" ")))
    holds = F.forall(F.concat("c.words", "c.phrases"), held) & ~F.exists(F.concat("c.barred_words", "c.barred_phrases"), held)
    return met.join(texts.hint("merge"), "id").where(holds).select("cond", "id")


_CLAUSE = "struct<words: array<string>, phrases: array<string>, barred_words: array<string>, barred_phrases: array<string>>"


def _clauses(query: Column | str) -> Column:
    def run(queries: pd.Series) -> pd.Series:
        return queries.map(lambda q: [vars(c) for c in S.clauses(q)])

    return F.pandas_udf(run, f"array<{_CLAUSE}>")(query)


def reuse_summaries(records: DataFrame) -> DataFrame:
    """(id, summary): what a record of equal title, type, section and reference type already has; the least id of several."""
    keys = ["title", "doc_type", "section", "ref_type"]
    known = first_per(records.where("summary is not null"), keys, [F.col("id")]).select(*(F.col(k).alias(f"k_{k}") for k in keys), F.col("summary").alias("known"))
    bare = records.where("summary is null").select("id", *keys)
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]
    return bare.join(known, same).select("id", F.col("known").alias("summary"))


def weekday_of(user: Column) -> Column:
    """A weekday 0 to 6 that spreads users evenly and never changes for one."""
    return F.pmod(F.xxhash64(user), F.lit(7)).cast("int")
