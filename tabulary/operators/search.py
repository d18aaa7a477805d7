"""Full-text search over folded texts: parse, expand, match, tier, snippets, suggestions.

A query is compiled on the driver into one boolean Column per reading of it
(strict, loose, direct), so that Catalyst sees a plain filter. Texts are folded
and single-spaced once (``search_text``); a term matches at the start of a word.

Words that PostgreSQL would split at hyphens are a phrase here. Malformed input
never fails: a lone quote or minus counts as a blank.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulary.functions.text import ACCENTED, MORE_ACCENTED, MORE_PLAIN, PLAIN, clean_body, let, normalize, similarity, squeeze, unaccent

#: Search term, alternative.
SYNONYMS = (
    ("kamulastirma", "istimlak"), ("istimlak", "kamulastirma"), ("kamulastirma", "zorla mal iktisabi"), ("munhal", "kadro"), ("kadro", "munhal"),
    ("tuzuk", "yonetmelik"), ("yonetmelik", "tuzuk"), ("kocan", "tapu"), ("tapu", "kocan"), ("kdv", "katma deger vergisi"),
    ("sgk", "sosyal sigortalar"), ("khk", "yasa gucunde kararname"), ("bkk", "bakanlar kurulu karari"), ("imar", "planlama onayi"),
    ("dizel", "motorin"), ("motorin", "dizel"), ("dizel", "diesel"), ("diesel", "dizel"), ("diesel", "motorin"), ("motorin", "diesel"),
)
#: The alternatives that only bridge a softened consonant.
BRIDGES = (("tuzuk", "tuzug"), ("toprak", "toprag"), ("kaynak", "kaynag"), ("ocak", "ocag"), ("yaprak", "yaprag"), ("sozlesme", "sozlesmes"))
NEAR = 3
COUNT_CAP = 10_000
PAGE_SIZE = 20


@dataclass(frozen=True)
class Node:
    """kind: word (lexemes of one), phrase, not, and, or."""

    kind: str
    words: tuple[str, ...] = ()
    parts: tuple[Node, ...] = ()


def fold_text(text: str) -> str:
    lower = text.translate(str.maketrans("İI", "iı")).lower()
    return lower.translate(str.maketrans(ACCENTED + MORE_ACCENTED, PLAIN + MORE_PLAIN))


def parse(query: str | None) -> Node | None:
    """Words are and-ed, quotes make phrases, OR is weaker than and, a leading minus negates."""
    groups: list[list[Node]] = [[]]
    for sign, quoted, word in re.findall(r'(-?)(?:"([^"]*)"|([^\s"]+))', query or ""):
        if word.upper() == "OR" and not sign:
            groups.append([])
            continue
        lexemes = tuple(re.findall("[a-z0-9]+", fold_text(quoted or word)))
        if lexemes:
            node = Node("word" if len(lexemes) == 1 else "phrase", lexemes)
            groups[-1].append(Node("not", parts=(node,)) if sign else node)
    made = [g[0] if len(g) == 1 else Node("and", parts=tuple(g)) for g in groups if g]
    return None if not made else made[0] if len(made) == 1 else Node("or", parts=tuple(made))


def _variants(lexeme: str, synonyms: tuple) -> str:
    """Regular expression of a word that starts with the lexeme, or of its alternatives."""
    out = [f"{lexeme}[^ ]*"]
    for term, alternative in synonyms:
        if term == lexeme:
            out.append(alternative if " " in alternative else f"{alternative}[^ ]*")
    return "(?:" + "|".join(out) + ")"


def _match(text: Column, node: Node, synonyms: tuple) -> Column:
    if node.kind == "not":
        return ~_match(text, node.parts[0], synonyms)
    if node.kind in ("and", "or"):
        return reduce((lambda a, b: a & b) if node.kind == "and" else (lambda a, b: a | b), (_match(text, p, synonyms) for p in node.parts))
    if len(node.words) == 1 and not any(t == node.words[0] for t, _ in synonyms):
        return text.contains(" " + node.words[0])
    return text.rlike(" " + " ".join(_variants(w, synonyms) for w in node.words) + " ")


def search_text(x: Column) -> Column:
    """Folded words between single blanks, one at each end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(unaccent(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", " ")), F.lit(" "))


def loose(text: Column, query: str | None) -> Column:
    """All words anywhere; null query: null."""
    node = parse(query)
    return F.lit(None).cast("boolean") if node is None else _match(text, node, SYNONYMS + BRIDGES)


def strict(text: Column, query: str | None, near: int = NEAR) -> Column:
    """As ``loose``, but each two neighbours of a plain run of words stand within ``near`` words, either way round."""
    node = parse(query)
    if node is None or near <= 0 or node.kind != "and" or any(p.kind != "word" for p in node.parts):
        return loose(text, query)
    words = [_variants(p.words[0], SYNONYMS + BRIDGES) for p in node.parts]
    gap = f"(?: [^ ]+){{0,{near - 1}}} "
    pairs = [text.rlike(f" (?:{a}{gap}{b}|{b}{gap}{a}) ") for a, b in zip(words, words[1:], strict=False)]
    return reduce(lambda a, b: a & b, pairs)


def direct(text: Column, query: str | None) -> Column:
    """The words themselves, with consonant bridges but no synonyms."""
    node = parse(query)
    return F.lit(None).cast("boolean") if node is None else _match(text, node, BRIDGES)


def recency_boost(date: Column, today: Column) -> Column:
    return F.when(date > F.date_sub(today, 90), 1.5).when(date > F.date_sub(today, 365), 1.2).otherwise(1.0)


def capped_count(df: DataFrame, cap: int = COUNT_CAP) -> DataFrame:
    """total, at most ``cap``, and whether it was reached."""
    return df.limit(cap).agg(F.count("*").alias("total")).withColumn("capped", F.col("total") >= cap)


def loose_extra(df: DataFrame, text_col: str, query: str, cap: int = COUNT_CAP) -> DataFrame:
    """How many more rows match when the words may stand far apart; both counts are capped."""
    both = df.select(F.coalesce(strict(F.col(text_col), query), F.lit(False)).alias("s"), F.coalesce(loose(F.col(text_col), query), F.lit(False)).alias("l")).where("s or l")
    sums = both.agg(F.count_if("s").alias("s"), F.count_if("l").alias("l"))
    capped = lambda c: F.least(F.col(c), F.lit(cap))
    return sums.select(F.greatest(F.lit(0).cast("long"), capped("l") - capped("s")).alias("extra"))


def facets(df: DataFrame, chosen: dict[str, list]) -> DataFrame:
    """(dimension, value, n): counts of each dimension under the filters of all the others, in one
    pass; without dimensions an empty table."""
    def passes(name: str) -> Column:
        return reduce(lambda a, b: a & b, (F.col(o).isin(*v) for o, v in chosen.items() if o != name and v), F.lit(True))

    value = lambda name: F.struct(F.lit(name).alias("dimension"), F.col(name).cast("string").alias("value"), F.coalesce(passes(name), F.lit(False)).alias("ok"))
    none = F.lit(None).cast("array<struct<dimension:string,value:string,ok:boolean>>")
    each = df.select(F.inline(F.array(*map(value, chosen)) if chosen else none)).where("ok")
    return each.groupBy("dimension", "value").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Clause:
    """One way to satisfy a query of plain words: the words that must be there, phrases too, and words and phrases that must not."""

    words: tuple[str, ...]
    phrases: tuple[str, ...]
    barred_words: tuple[str, ...]
    barred_phrases: tuple[str, ...]


def clauses(query: str | None) -> list[Clause]:
    """The ways to satisfy a query word by word, without prefixes, synonyms or proximity; none for a blank one."""
    node = parse(query)
    out = []
    for way in () if node is None else node.parts if node.kind == "or" else (node,):
        parts = way.parts if way.kind == "and" else (way,)
        yes, no = [p for p in parts if p.kind != "not"], [p.parts[0] for p in parts if p.kind == "not"]
        distinct = lambda x: tuple(sorted(set(x)))
        out.append(Clause(distinct(w for p in yes for w in p.words), distinct(" ".join(p.words) for p in yes if p.kind == "phrase"),
                          distinct(p.words[0] for p in no if p.kind == "word"), distinct(" ".join(p.words) for p in no if p.kind == "phrase")))
    return out


def tiered_page(df: DataFrame, text_col: str, query: str, order: list[Column], page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """A page of strict matches, direct ones first, then by ``order``; column ``tier``: 1 direct, 0 not."""
    t = F.col(text_col)
    hits = df.where(strict(t, query)).withColumn("tier", F.coalesce(direct(t, query), F.lit(False)).cast("int"))
    return hits.orderBy(F.desc("tier"), *order).offset((page - 1) * size).limit(size)


def suggest(df: DataFrame, title_col: str, query: str, order: list[Column], least: float = 0.3) -> DataFrame:
    """The most similar title by trigrams, if over ``least``; none for queries below three letters."""
    q = fold_text(query).strip()
    rows = df.withColumn("similarity", similarity(F.col(title_col), F.lit(q)))
    return rows.where((F.col("similarity") > least) & F.lit(len(q) >= 3)).orderBy(F.desc("similarity"), *order).limit(1)


def entity_search(df: DataFrame, name_col: str, count_col: str, query: str, limit: int = 8, least: int = 2) -> DataFrame:
    """Names that hold the query or resemble it: prefix first, then inner matches, then by count and name."""
    q = fold_text(query).strip()
    n = F.col(name_col)
    rows = df.where((F.col(count_col) >= least) & F.lit(len(q) >= 2)).where(n.contains(q) | (similarity(n, F.lit(q)) > 0.3))
    return rows.orderBy(n.startswith(q).desc(), n.contains(q).desc(), F.desc(count_col), n).limit(limit)


def law_filter(df: DataFrame, title_col: str, ref_col: str, query: str, order: list[Column]) -> DataFrame:
    """Every term starts a word of title or reference; titles that start with the whole query first."""
    terms = squeeze_text(query).split()
    if not terms:
        return df.limit(0)
    text = normalize(F.concat_ws(" ", title_col, ref_col))
    rows = df.withColumn("__t", text)
    for t in terms:
        rows = rows.where(F.col("__t").rlike(f"(^|[^a-z0-9]){re.escape(t)}"))
    return rows.orderBy(F.col("__t").startswith(" ".join(terms)).desc(), *order).drop("__t")


def squeeze_text(text: str) -> str:
    lower = text.translate(str.maketrans("İI", "iı")).lower().translate(str.maketrans(ACCENTED, PLAIN))
    return " ".join(lower.split())


def plain_words(query: str) -> list[str] | None:
    """The words of a plain run of two or more, else None."""
    words = query.split()
    if len(words) < 2 or '"' in query or any(w.startswith("-") or w.lower() == "or" for w in words):
        return None
    return words


#: Most and least words of a snippet, and letters of a word that ends none.
MOST_WORDS, LEAST_WORDS, SHORT_WORD = 40, 20, 3


def _items(query: str | None) -> list[str]:
    """A pattern for each distinct word of a query, of words that stand for it; it is met where a folded word begins."""
    words = dict.fromkeys(w for n in _leaves(parse(query)) for w in n.words)
    return ["(?:" + "|".join(v if " " not in v else "|".join(f"{x}(?![^ ])" for x in v.split()) for v in [w, *(a for t, a in SYNONYMS + BRIDGES if t == w)]) + ")" for w in words]


def snippet(body: Column, query: str | None, most: int = MOST_WORDS, least: int = LEAST_WORDS, short: int = SHORT_WORD) -> Column:
    """The best stretch of up to ``most`` words of the whole body, matches between \\u0001 and \\u0002.

    Of all stretches that begin with a match the one with the most different words of the query is
    taken, then the shortest, then the first. It grows by half of what is left to the left and by
    the rest to the right; ends then go back over words of up to ``short`` letters that match
    nothing. A body without a match gives its first ``least`` words. The query is read loosely.

    The body is cut before each match only, and these pieces are folded once from the last to the
    first, so a long body is never held word by word and the work is linear in it.
    """
    items = _items(query)
    first = lambda text: F.substring_index(text, " ", least)
    if not items:
        return first(clean_body(body))
    one_of = "|".join(items)
    folded = lambda t: F.regexp_replace(unaccent(t), "(?! )[^a-z0-9]", "")
    blanks = lambda t: F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    word = lambda w: let(folded(w), lambda f: F.struct(w.alias("w"), f.rlike(f"^(?:{one_of})").alias("hit"), (F.length(f) <= short).alias("short")))

    def best(pieces: Column) -> Column:
        # A piece is a match and the words up to the next; the one before all matches has a blank before each word.
        hits = F.transform(F.slice(pieces, 2, F.size(pieces)), lambda p: F.struct((blanks(p) + 1).alias("n"), F.array(*(p.rlike(f"^{x}") for x in items)).alias("has")))
        none = F.struct(F.lit(0).alias("left"), F.array(*(F.lit(None).cast("int") for _ in items)).alias("next"), F.lit(None).cast("struct<rank:int,more:int,at:int>").alias("best"))
        before = blanks(F.get(pieces, F.lit(0)))
        return F.aggregate(F.reverse(hits), none, step, lambda s: F.when(s["best"].isNotNull(), F.struct(
            (before + s["left"] + s["best"]["at"]).alias("begin"), s["best"]["more"].alias("more"), (before + s["left"]).alias("n"))))

    def step(s: Column, x: Column) -> Column:
        # Places are counted as words left from there to the end of the body.
        left = s["left"] + x["n"]
        nexts = [F.when(F.get(x["has"], F.lit(k)), left).otherwise(F.get(s["next"], F.lit(k))) for k in range(len(items))]
        far = [F.when(left - n < most, left - n) for n in nexts]
        found = F.struct(F.negative(reduce(lambda a, b: a + b, (f.isNotNull().cast("int") for f in far))).alias("rank"), F.greatest(F.lit(0), *far).alias("more"), F.negative(left).alias("at"))
        return F.struct(left.alias("left"), F.array(*nexts).alias("next"), F.least(s["best"], found).alias("best"))

    def good(words: Column, i: Column) -> Column:
        x = F.get(words, i)
        return ~x["short"] | x["hit"]

    def cut(text: Column, b: Column) -> Column:
        left = F.greatest(F.lit(0), b["begin"] - F.floor((most - (b["more"] + 1)) / 2).cast("int"))
        upto = F.least(b["n"], b["begin"] + most)
        stretch = F.call_function("substring_index", F.call_function("substring_index", text, F.lit(" "), upto), F.lit(" "), left - upto)
        return let(F.transform(F.split(stretch, " "), word), lambda words: trimmed(words, b["begin"] - left, b["begin"] - left + b["more"]))

    def trimmed(words: Column, begin: Column, end: Column) -> Column:
        start = F.array_min(F.filter(F.sequence(F.lit(0), begin), lambda i: good(words, i) | (i == begin)))
        return let(start, lambda at: let(F.least(F.size(words), at + most) - 1, lambda right: marked(
            words, at, F.array_max(F.filter(F.sequence(end, right), lambda i: good(words, i) | (i == end))))))

    def marked(words: Column, begin: Column, end: Column) -> Column:
        one = lambda x: F.when(x["hit"], F.concat(F.lit("\u0001"), x["w"], F.lit("\u0002"))).otherwise(x["w"])
        return F.array_join(F.transform(F.slice(words, begin + 1, end - begin + 1), one), " ")

    pieces = lambda text: F.split(F.regexp_replace(F.concat(F.lit(" "), folded(text)), f" (?={one_of})", "\u0001"), "\u0001")
    return let(clean_body(body), lambda text: let(let(pieces(text), best), lambda b: F.when(b.isNull(), first(text)).otherwise(cut(text, b))))


def _leaves(node: Node | None) -> list[Node]:
    if node is None or node.kind == "not":
        return []
    return [node] if node.words else [x for p in node.parts for x in _leaves(p)]


#: Weights of the classes of a record's text: title; subject and summary; body; anything else.
CLASS_WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}


def cover_density(text: Column, query: str | None, weight: float = 0.1) -> Column:
    """``weighted_density`` of one text of one weight."""
    return weighted_density([(text, weight)], query)


def weighted_density(texts: list[tuple[Column, float]], query: str | None) -> Column:
    """Rank of a record's folded texts (``search_text``), one after the other, each with the weight of its class.

    Each shortest stretch that holds all words of the query adds the harmonic mean of the weights of its
    matching words, divided by one more than the other words in it. An OR ranks as its better
    side; null query: null. The matching words are folded once from the last to the first, so the
    work is linear in the texts.
    """
    node = parse(query)
    if node is None:
        return F.lit(None).cast("double")
    parts = [F.filter(F.split(F.trim(t), " "), lambda w: w != "") for t, _ in texts]
    placed = [F.transform(p, lambda w: F.struct(w.alias("w"), F.lit(1 / weight).alias("inv"))) for p, (_, weight) in zip(parts, texts, strict=True)]
    return _density(placed[0] if len(placed) == 1 else F.concat(*placed), node)


def rank(text: Column, query: str | None, date: Column, today: Column) -> Column:
    """Cover density, to six digits, times the boost of recent records."""
    return F.round(cover_density(text, query), 6) * recency_boost(date, today)


def weighted_rank(texts: list[tuple[Column, float]], query: str | None, date: Column, today: Column) -> Column:
    """Weighted density, to six digits, times the boost of recent records."""
    return F.round(weighted_density(texts, query), 6) * recency_boost(date, today)


def _density(parts: Column, node: Node) -> Column:
    if node.kind == "or":
        return F.greatest(*(_density(parts, p) for p in node.parts))
    words = list(dict.fromkeys(w for leaf in _leaves(node) for w in leaf.words))
    if not words:
        return F.lit(0.0)
    has = lambda w: F.array(*(w.rlike(f"^{_variants(x, SYNONYMS + BRIDGES)}$") for x in words))
    hits = F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("at"), p["inv"].alias("inv"), has(p["w"]).alias("has"))), lambda x: F.array_contains(x["has"], True))
    none = F.array(*(F.lit(None).cast("struct<at:int,i:int,inv:double>") for _ in words))
    first = F.struct(none.alias("next"), F.lit(0).alias("i"), F.lit(0.0).alias("inv"), F.lit(-1).alias("end"), F.lit(0.0).alias("sum"))

    def step(s: Column, x: Column) -> Column:
        # Of the matching words behind x: how many there are, and the sum of their inverse weights.
        near = F.transform(s["next"], lambda n, k: F.when(F.get(x["has"], k), F.struct(x["at"].alias("at"), s["i"].alias("i"), s["inv"].alias("inv"))).otherwise(n))

        def added(n: Column) -> Column:
            end = F.array_max(n)
            new = ~F.exists(n, lambda e: e.isNull()) & (end["at"] != s["end"])
            mean = (s["i"] - end["i"] + 1) / (s["inv"] + x["inv"] - end["inv"])
            more = F.when(new, mean / (1 + end["at"] - x["at"] - (s["i"] - end["i"]))).otherwise(0.0)
            return F.struct(n.alias("next"), (s["i"] + 1).alias("i"), (s["inv"] + x["inv"]).alias("inv"), F.when(new, end["at"]).otherwise(s["end"]).alias("end"), (s["sum"] + more).alias("sum"))

        return F.element_at(F.transform(F.array(near), added), 1)

    return F.aggregate(F.reverse(hits), first, step, lambda s: s["sum"])


def headline_tokens(x: Column) -> Column:
    """array<struct<t, lvl>>: marked stretches are level 3, the rest 0; null where nothing is left."""
    pieces = F.split(F.coalesce(x, F.lit("")), "\u0001")

    def of(p: Column, i: Column) -> Column:
        token = lambda t, lvl: F.struct(t.alias("t"), F.lit(lvl).alias("lvl"))
        closed = F.array(token(F.substring_index(p, "\u0002", 1), 3), token(F.substring(p, F.instr(p, "\u0002") + 1, F.length(p)), 0))
        return F.when(i == 0, F.array(token(p, 0))).when(F.instr(p, "\u0002") > 0, closed).otherwise(F.array(token(p, 3)))

    tokens = F.filter(F.flatten(F.transform(pieces, of)), lambda t: F.length(t["t"]) > 0)
    return F.element_at(F.transform(F.array(tokens), lambda t: F.when(F.size(t) > 0, t)), 1)


def snippet_or_lead_in(body: Column, query: str | None, longest: int = 200) -> Column:
    """A snippet for a query, else the first characters of the body."""
    if query and query.strip():
        return snippet(body, query)
    t = F.nullif(squeeze(body), F.lit(""))
    return F.when(F.length(t) > longest, F.concat(F.left(t, F.lit(longest)), F.lit("…"))).otherwise(t)


def match_terms(query: str) -> list[str]:
    """What to highlight: quoted phrases of two letters or more, words of three or more, longest first."""
    terms = [t for q in re.findall('"([^"]+)"', query) if len(t := squeeze_text(q)) >= 2]
    terms += [w for w in squeeze_text(re.sub('"[^"]+"', " ", query)).split() if len(w) >= 3 and not w.startswith("-")]
    return sorted(terms, key=len, reverse=True)


def overlay_matches(tokens: Column, query: str) -> Column:
    """Tokens (t, lvl) with the query's matches at word starts as tokens of level 3.

    Places are found in the folded text, which has the same length; a token is cut
    at the places where being inside a match changes.
    """
    terms = match_terms(query)
    if not terms:
        return tokens

    def cut(token: Column) -> Column:
        folded = F.translate(F.lower(F.translate(token["t"], "İI", "iı")), ACCENTED, PLAIN)
        pattern = "(?<![a-z0-9])(?:" + "|".join(map(re.escape, terms)) + ")"
        marked = F.regexp_replace(folded, pattern, "\u0001$0\u0002")

        def pieces(m: Column) -> Column:
            parts = F.filter(F.split(m, "(?=\u0001)|(?<=\u0002)"), lambda p: p != "")
            sized = F.transform(parts, lambda p: F.struct(F.length(F.translate(p, "\u0001\u0002", "")).alias("n"), p.startswith("\u0001").alias("hit")))
            ends = F.aggregate(sized, F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + p["n"])))
            one = lambda p, i, e: F.struct(F.substring(token["t"], F.get(e, i) + 1, p["n"]).alias("t"), F.when(p["hit"], 3).otherwise(token["lvl"]).alias("lvl"))
            return F.element_at(F.transform(F.array(ends), lambda e: F.transform(sized, lambda p, i: one(p, i, e))), 1)

        return F.element_at(F.transform(F.array(marked), pieces), 1)

    return F.flatten(F.transform(tokens, cut))
