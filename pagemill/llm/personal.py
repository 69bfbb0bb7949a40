"""Personal data: patterns for well-formed identifiers, and bootstrapped contexts for others.

Base spans are the well-formed e-mail addresses, IP addresses, card and phone numbers
of a text.  They are the seeds of a bootstrap: the two words before a seed are a
lexical pattern, and every identifier-like word behind that pattern is one of its
instances, also in groups of digits with blanks between them.  Patterns and instances form a graph that Spark scores in rounds: a pattern
by the number of its instances believed to be personal, an instance by the patterns
that hold it.  Accepted instances are believed like seeds, and rounds go on until no
instance is added.  Accepted instances are found wherever they stand.

Everything is Catalyst expressions over whole texts; every regular expression is
written so that the time is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import materialise
from pagemill.llm.rules import let

# The kinds in order and what they look like.  Possessive quantifiers and
# look-behinds only spare retries; the matches are those of the plain patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain at all before a pattern is tried.
HINTS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: A word with a digit or an @ that may be an identifier.
LIKELY = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Groups of digits with blanks between them, brackets and hyphens included; what stands between two groups, and
#: the digits of an identifier in groups.
GROUPS = r"(?<![0-9A-Za-z@_])(?<![0-9][.-])[0-9][0-9().-]*+(?![A-Za-z@_])(?:\x20[\x20()-]*+[0-9][0-9().-]*+(?![A-Za-z@_]))++"
GAP = r"\x20[\x20()-]*+"
LEAST_DIGITS, MOST_DIGITS = 7, 19
#: Characters of the text before a span in which its pattern's words are looked for.
CONTEXT_CHARS = 64
#: A pattern counts from this many different believed instances on, and an instance is accepted from this confidence on.
MIN_SEEDS, MIN_CONFIDENCE = 5, 0.8

SPAN = "array<struct<kind:string,s:int,e:int,inst:string,pat:string>>"


# -- places -------------------------------------------------------------------
def running_sums(values: Column) -> Column:
    """Running sums of an int array.

    Summed within blocks of the square root of the length and then over blocks, as
    an array that grows one by one is copied at every step.
    """
    def scan(a: Column) -> Column:
        return F.slice(F.aggregate(a, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))),
                       2, F.greatest(F.size(a), F.lit(1)))

    def blocks(a: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(a))).cast("int")
        return let(width, lambda w: F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / w).cast("int") - 1),
                                                lambda b: scan(F.slice(a, b * w + 1, w))))

    def joined(inner: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), scan(F.transform(inner, lambda x: F.element_at(x, -1))))
        return F.flatten(F.zip_with(inner, F.slice(before, 1, F.size(inner)), lambda x, o: F.transform(x, lambda v: v + o)))

    return let(values, lambda a: F.when(F.size(a) > 0, let(blocks(a), joined)).otherwise(F.array().cast("array<int>")))


def _tails(pieces: Column) -> Column:
    """The last CONTEXT_CHARS characters of each running concatenation of non-empty strings, by doubling."""
    def level(t: Column, reach: int) -> Column:
        if reach >= CONTEXT_CHARS:
            return t
        earlier = F.concat(F.array_repeat(F.lit(""), reach), F.slice(t, F.lit(1), F.greatest(F.size(t) - reach, F.lit(0))))
        wider = F.zip_with(earlier, t, lambda x, y: F.right(F.concat(x, y), F.lit(CONTEXT_CHARS)))
        return let(F.when(F.size(t) > reach, wider).otherwise(t), lambda w: level(w, 2 * reach))
    return let(F.transform(pieces, lambda x: F.right(x, F.lit(CONTEXT_CHARS))), lambda t: level(t, 1))


def located(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` as (s, e, m, before): code points, end exclusive, and the end of the text before the match."""
    steps = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                       lambda p, m: F.struct(p.alias("p"), m.alias("m"), F.length(p).alias("lp"), F.length(m).alias("lm")))

    def placed(all_steps: Column) -> Column:
        x = F.slice(all_steps, 1, F.size(all_steps) - 1)  # the last piece has no match behind it
        return let(x, lambda steps: F.zip_with(
            F.zip_with(steps, running_sums(F.transform(steps, lambda z: z["lp"] + z["lm"])), lambda z, e: F.struct(z.alias("z"), e.alias("e"))),
            F.concat(F.array(F.lit("")), _tails(F.transform(F.slice(steps, 1, F.size(steps) - 1), lambda z: F.concat(z["p"], z["m"])))),
            lambda y, t: F.struct((y["e"] - y["z"]["lm"]).alias("s"), y["e"].alias("e"), y["z"]["m"].alias("m"),
                                  F.right(F.concat(t, F.right(y["z"]["p"], F.lit(CONTEXT_CHARS))), F.lit(CONTEXT_CHARS)).alias("before"))))

    none = F.array().cast("array<struct<s:int,e:int,m:string,before:string>>")
    return F.when(text.rlike(pattern), let(steps, placed)).otherwise(none)


# -- kinds --------------------------------------------------------------------
def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * (F.lit(1) + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)
    chars = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, value), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return let(digits(m), lambda d: F.length(d).between(16, 19) & luhn(d))
    return F.length(digits(m)).between(8, 15)


def pattern_of(before: Column) -> Column:
    """The last two words before a span, lower case and digits as 0; null without two words."""
    words = F.regexp_extract(F.lower(before), r"([^\x20\x09-\x0D]++[\x20\x09-\x0D]++[^\x20\x09-\x0D]++)[\x20\x09-\x0D\"'(<:=]*$", 1)
    return F.nullif(F.regexp_replace(F.regexp_replace(words, "[0-9]", "0"), r"[\x20\x09-\x0D]+", " "), F.lit(""))


def instance_of(m: Column) -> Column:
    return F.regexp_replace(F.lower(m), r"^[^0-9a-z@+]+|[^0-9a-z]+$", "")


def base_spans(text: Column, kind: str) -> Column:
    found = located(text, PATTERNS[kind])
    spans = F.transform(F.filter(found, lambda z: valid(kind, z["m"])), lambda z: F.struct(
        F.lit(kind).alias("kind"), z["s"].alias("s"), z["e"].alias("e"),
        instance_of(z["m"]).alias("inst"), pattern_of(z["before"]).alias("pat"))).cast(SPAN)
    return F.when(F.contains(text, F.lit(HINTS[kind])), spans).otherwise(F.array().cast(SPAN)) if HINTS[kind] else spans


def likely_kind(inst: Column) -> Column:
    """The kind whose form a word comes near to, or null."""
    n = F.length(digits(inst))
    return (F.when(F.contains(inst, F.lit("@")), F.lit("email"))
            .when(inst.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), F.lit("ip"))
            .when(inst.rlike(r"^[0-9][0-9-]*$") & n.between(12, 19), F.lit("card"))
            .when(inst.rlike(r"^[+(]?[0-9][0-9().-]*$") & n.between(7, 11), F.lit("phone")))


def number_of(inst: Column) -> Column:
    """Groups of digits joined by hyphens, so that one number is one instance in any layout."""
    return F.regexp_replace(F.regexp_replace(inst, "[^0-9]+", "-"), "^-|-$", "")


def grouped_spans(z: Column) -> Column:
    """Every two or more neighbouring groups of a match of GROUPS that have the digits of an identifier together."""
    pieces = F.zip_with(F.split(z["m"], GAP, -1), F.regexp_extract_all(z["m"], F.lit(GAP), F.lit(0)), lambda g, gap: F.struct(
        g.alias("g"), F.coalesce(gap, F.lit("")).alias("gap"), F.length(digits(g)).alias("n")))

    def placed(x: Column) -> Column:
        ends = running_sums(F.transform(x, lambda w: F.length(w["g"]) + F.length(w["gap"])))
        both = F.zip_with(ends, running_sums(F.transform(x, lambda w: w["n"])), lambda e, c: F.struct(e.alias("e"), c.alias("c")))
        return F.transform(F.zip_with(x, both, lambda w, y: F.struct(
            w["g"].alias("g"), w["gap"].alias("gap"), (y["c"] - w["n"]).alias("before"), y["c"].alias("c"),
            (y["e"] - F.length(w["g"]) - F.length(w["gap"])).alias("s"))), lambda w, i: F.struct(w.alias("w"), i.alias("i")))

    def spans(q: Column) -> Column:
        def of(first: Column) -> Column:
            w, i = first["w"], first["i"]
            # Every group has a digit, so later ones have too many digits.
            ends = F.filter(F.slice(q, i + 2, F.lit(MOST_DIGITS - 1)),
                            lambda v: (v["w"]["c"] - w["before"]).between(LEAST_DIGITS, MOST_DIGITS))
            words = F.array_join(F.transform(F.slice(q, F.greatest(i - 1, F.lit(1)), F.least(i, F.lit(2))),
                                             lambda v: F.concat(v["w"]["g"], v["w"]["gap"])), "")
            pat = pattern_of(F.concat(F.when(i <= 2, z["before"]).otherwise(" "), words))

            def span(v: Column) -> Column:
                number = number_of(F.array_join(F.transform(F.slice(q, i + 1, v["i"] - i + 1), lambda u: u["w"]["g"]), " "))
                end = z["s"] + v["w"]["s"] + F.length(F.regexp_replace(v["w"]["g"], "[^0-9]+$", ""))
                return let(number, lambda n: F.struct(likely_kind(n).alias("kind"), (z["s"] + w["s"]).alias("s"), end.alias("e"),
                                                      n.alias("inst"), pat.alias("pat")))
            return F.transform(ends, span)
        return F.flatten(F.transform(q, of))
    return let(pieces, lambda x: let(placed(x), spans)).cast(SPAN)


def likely_spans(text: Column, base: Column) -> Column:
    """Identifier-like words, and groups of digits with blanks between them, that touch no base span."""
    def span(z: Column) -> Column:
        return let(instance_of(z["m"]), lambda i: let(F.instr(F.lower(z["m"]), i) - 1, lambda o: let(likely_kind(i), lambda kind: F.struct(
            kind.alias("kind"), (z["s"] + F.greatest(o, F.lit(0))).alias("s"), (z["s"] + F.greatest(o, F.lit(0)) + F.length(i)).alias("e"),
            F.when(kind.isin("card", "phone"), number_of(i)).otherwise(i).alias("inst"), pattern_of(z["before"]).alias("pat")))))
    found = F.concat(F.transform(located(text, LIKELY), span).cast(SPAN), F.flatten(F.transform(located(text, GROUPS), grouped_spans)))
    typed = F.filter(found, lambda z: z["kind"].isNotNull())
    return F.filter(typed, lambda z: ~F.exists(base, lambda b: (b["s"] < z["e"]) & (z["s"] < b["e"])))


def widest(spans: Column) -> Column:
    """The spans that lie in no wider one."""
    return F.filter(spans, lambda z: ~F.exists(spans, lambda y: (y["s"] <= z["s"]) & (z["e"] <= y["e"]) & (y["e"] - y["s"] > z["e"] - z["s"])))


# -- bootstrap ------------------------------------------------------------------
def found_spans(docs: DataFrame) -> DataFrame:
    """(row, doc_id, hash, base, likely) of every document; ``row`` numbers the written rows, ``hash`` is of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).withColumn("base", F.concat(*(base_spans(F.col("text"), k) for k in KINDS)))
    rows = base.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("hash"), "base", likely_spans(F.col("text"), F.col("base")).alias("likely"))
    return materialise(rows, "found_spans")


def graph(found: DataFrame) -> DataFrame:
    """Edges (kind, pat, inst, seed): every instance once per pattern, however often it stands there.

    Partial sums collapse an identifier that very many documents hold before it moves.
    """
    def edges(column: str, seed: bool) -> DataFrame:
        spans = found.select(F.explode(column).alias("z")).select("z.kind", "z.pat", "z.inst").where("pat IS NOT NULL AND inst != ''")
        return spans.withColumn("seed", F.lit(seed))
    both = edges("base", True).unionByName(edges("likely", False))
    return both.groupBy("kind", "pat", "inst").agg(F.max("seed").alias("seed"))


def bootstrap(edges: DataFrame, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(kind, inst) of the accepted instances that aren't seeds.

    A pattern with s believed instances, seeds or accepted ones, is right with confidence
    s / (s + 1), the fixed point of the share of believed ones among all its instances and one
    more, where each unseen instance is believed as far as the pattern is.  Unseen instances
    count neither for nor against a pattern.  What is accepted is only ever added to and
    decides the next round, so the rounds end when one adds nothing.  Patterns with fewer
    instances of any sort than ``min_seeds`` can never count and leave before the first round.
    """
    node = ["kind", "pat"]
    able = edges.groupBy(*node).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_seeds).select(*node)
    edges = materialise(edges.join(able, node).withColumnRenamed("seed", "believed"), "pattern_graph")
    accepted = edges.select("kind", "inst").limit(0)  # rows made in Python would start workers of their own on each executor
    while True:
        believed = F.count_if("believed")
        patterns = edges.groupBy(*node).agg(believed.alias("_s")).where(F.col("_s") >= min_seeds)
        held = edges.where("NOT believed").join(patterns, node)
        # Noisy or: an instance is personal unless each of its patterns is wrong about it, each with 1 / (s + 1).
        belief = held.groupBy("kind", "inst").agg((1 - F.exp(-F.sum(F.log1p("_s")))).alias("_belief"))
        fresh = materialise(belief.where(F.col("_belief") >= min_confidence).select("kind", "inst"), "accepted")
        if fresh.isEmpty():
            return accepted
        accepted = materialise(accepted.unionByName(fresh).distinct(), "accepted")
        edges = materialise(edges.join(fresh.withColumn("_fresh", F.lit(True)), ["kind", "inst"], "left").select(
            *node, "inst", (F.col("believed") | F.coalesce("_fresh", F.lit(False))).alias("believed")), "pattern_graph")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda z: F.concat_ws(":", z["kind"], z["s"].cast("string"), z["e"].cast("string"))), ",")


def _of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda z: z["kind"] == kind)


def _ordered(spans: Column) -> Column:
    """By kind as listed, then start."""
    return F.concat(*(F.array_sort(_of_kind(spans, k), lambda a, b: a["s"] - b["s"]) for k in KINDS))


def personal_spans(docs: DataFrame, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(row, doc_id, base, more) of every document, as arrays of spans; ``more`` is what the contexts add."""
    found = found_spans(docs)
    accepted = bootstrap(graph(found), min_seeds)
    likely = found.select("row", F.explode("likely").alias("z")).select("row", "z", "z.kind", "z.inst")
    more = likely.join(accepted, ["kind", "inst"]).groupBy("row").agg(widest(F.collect_list("z")).alias("more"))
    return found.select("row", "doc_id", "base").join(more, "row", "left").withColumn(
        "more", F.coalesce("more", F.array().cast(SPAN)))


def extract(docs: DataFrame, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more) of every document.

    Counts and hash are of the base spans, ``spans`` lists base and added ones as
    kind:start:end by kind and start, in code points.  Null and empty texts have none;
    repeated rows are judged each; columns other than doc_id and text are ignored.
    """
    spans = personal_spans(docs, min_seeds)
    counts = [F.size(_of_kind(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                        _joined(_ordered(F.concat("base", "more"))).alias("spans"), F.size("more").cast("long").alias("n_more"))


def _merged(spans: Column) -> Column:
    """Overlapping spans as one, under the kind of the first; ascending."""
    def add(acc: Column, z: Column) -> Column:
        last = F.element_at(acc, -1)
        wider = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["kind"].alias("kind"), last["s"].alias("s"), F.greatest(last["e"], z["e"]).alias("e"))))
        return F.when((F.size(acc) > 0) & (F.coalesce(last["e"], F.lit(0)) > z["s"]), wider).otherwise(F.concat(acc, F.array(z)))
    slim = F.array_sort(F.transform(spans, lambda z: F.struct(z["s"].alias("s"), z["e"].alias("e"), z["kind"].alias("kind"))))
    ordered = F.transform(slim, lambda z: F.struct(z["kind"].alias("kind"), z["s"].alias("s"), z["e"].alias("e")))
    return F.aggregate(ordered, F.array().cast("array<struct<kind:string,s:int,e:int>>"), add)


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets."""
    def rebuilt(m: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(m, lambda z: z["e"]))
        parts = F.zip_with(starts, m, lambda a, z: F.when(z.isNull(), F.substr(text, a + 1)).otherwise(
            F.concat(F.substr(text, a + 1, z["s"] - a), F.lit("["), F.upper(z["kind"]), F.lit("]"))))
        return F.array_join(parts, "")
    return F.when(F.size(spans) == 0, text).otherwise(let(_merged(spans), rebuilt))


def redact(docs: DataFrame, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """The documents with personal data replaced by [EMAIL], [IP], [CARD] or [PHONE]; same rows and columns.

    Base spans come from the text at hand; the accepted instances from the whole corpus.
    """
    names = docs.columns
    found = found_spans(docs)
    accepted = bootstrap(graph(found), min_seeds)
    likely = found.where(F.size("likely") > 0).select("hash", F.explode("likely").alias("z")).select("hash", "z.kind", "z.inst")
    # Texts that hold an accepted instance, with the instances: few, and joined by the text's
    # hash, so that rows without doc_id have theirs too.  What a text doesn't hold isn't found in it.
    hits = likely.join(accepted, ["kind", "inst"]).groupBy(F.col("hash").alias("_hash")).agg(F.collect_set("inst").alias("_insts"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row")).withColumn("_hash", F.xxhash64(text)).join(hits, "_hash", "left")
    rows = rows.withColumn("_base", F.concat(*(base_spans(text, k) for k in KINDS)))
    more = F.when(F.col("_insts").isNotNull(), F.filter(likely_spans(text, F.col("_base")), lambda z: F.array_contains(F.col("_insts"), z["inst"])))
    rows = rows.withColumn("_all", F.concat("_base", F.coalesce(more, F.array().cast(SPAN))))
    new = F.when(F.size("_all") == 0, F.col("row.text")).otherwise(redacted(text, F.col("_all")))
    rows = rows.withColumn("_text", new)
    def column(n: str) -> Column:
        if n == "text":
            return F.col("_text").alias(n)
        if n == "n_chars":
            return F.when(F.size("_all") == 0, F.col("row.n_chars")).otherwise(F.length("_text")).cast(docs.schema[n].dataType).alias(n)
        return F.col(f"row.`{n}`").alias(n)
    return rows.select(*(column(n) for n in names))
