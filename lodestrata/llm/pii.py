r"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base spans come from four patterns. Positions follow from splitting a text at the pattern: the lengths of the pieces and
of the matches, summed up, are the starts and ends (code points). The patterns match what their plain forms match, with
runs anchored at their first character (or where the last match ended, \G) and possessive quantifiers, so that a long
run of one character class costs time in proportion to its length and no stack.

The base spans seed a bootstrap over the whole corpus. A lexical pattern is the word in front of a span, or the two words, or
the word or two words behind it; its
instances are the seeds and the other identifier-like tokens (with a digit, 5 characters or more) that stand beside it. Words end
at white space and after punctuation, so that a label written against its value (`id:AB-1234`) is a word as well. Each round
scores the pattern-instance graph: a pattern by the share of all its occurrences in the corpus that a known instance
stands beside, and by the number of different ones; an instance by the noisy-or of the patterns that accepted ones give it.
High-confidence patterns make new instances known, which score patterns in the next round. Tokens of accepted instances
become spans of kind `id` wherever they stand, unless they overlap a base span.

The rounds end when one accepts nothing new; every pattern counts in each round in which it has MIN_KNOWN known instances,
be they seeds or instances that earlier rounds accepted.

Nothing is grouped by document in the bootstrap, only counted by pattern and instance (partial sums on the map side, and
joins that can split a hot key). Occurrences are counted in one pass over the texts, of words and of the pairs that are patterns: up
to MOST_PAIRS of those are broadcast, a longer list is joined to the counts of all pairs of words. What is done within a text takes time in proportion to its length:
prefix sums and running maxima run in blocks, overlaps come from one sorted list.

Defined cases: a null or empty text has no spans; repeated rows each get their own result; further columns are ignored (redact keeps
them, whatever their names); an empty table gives no rows; a very long text is scanned whole, in the memory of its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import forget, last_only, materialize, merge, table, unused, with_row_key

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: An identifier-like token: a whole run of these characters with a digit in it.
TOKEN = r"(?<![A-Za-z0-9._@/+-])(?=[A-Za-z._@/+-]*+[0-9])[A-Za-z0-9._@/+-]{5,}+"
OCTETS = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?){3}$"
#: Punctuation that ends a word, what words are made of, and a word.
LABEL, BODY = r"[\p{P}\p{S}&&[^._@/+%-]]", r"[[^\s\p{P}\p{S}]._@/+%-]"
UNIT = f"{BODY}++{LABEL}*+|{LABEL}++"
BLOCK, PIECE, MOST_PAIRS = 128, 4096, 1 << 18
MIN_KNOWN, MIN_PATTERN, MIN_INSTANCE = 3, 0.5, 0.8


def running(a: Column, combine, zero: int) -> Column:
    """Inclusive running combination of an array of longs, in blocks, so that the copying done by concat stays linear."""

    def along(x: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda s, v: F.struct(combine(s["at"], v).alias("at"), F.concat(s["out"], F.array(combine(s["at"], v))).alias("out"))
        return F.aggregate(x, first, step, lambda s: s["out"])

    none = F.lit(zero).cast("bigint")
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / BLOCK).cast("int") - 1, F.lit(0)))
    part = lambda b: F.slice(a, b * BLOCK + 1, BLOCK)
    whole = along(F.transform(blocks, lambda b: F.aggregate(part(b), none, combine)), none)
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), F.concat(F.array(none), whole).alias("before")), lambda z: F.when(z["b"].isNotNull(), along(part(z["b"]), z["before"])).otherwise(F.array().cast("array<bigint>"))))


def running_sums(a: Column) -> Column:
    return running(a, lambda x, y: x + y, 0)


def larger(x: Column, y: Column) -> Column:
    return F.greatest(x, y)


def running_maxima(a: Column) -> Column:
    return running(a, larger, 0)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    r = F.reverse(x)
    value = lambda i: F.substring(r, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when(i % 2 == 0, value(i) * 2 - F.when(value(i) > 4, 9).otherwise(0)).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(1), F.length(x)), F.lit(0), lambda s, i: s + doubled(i)) % 10 == 0


def valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(OCTETS)
    n = F.length(digits(x))
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), luhn(digits(x))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def contexts(before: Column, behind: Column) -> Column:
    """Patterns of a span: the last word and the last two of the text before it (<), the first and the first two behind it (>).

    In lower case; the text before is turned round, so that the search begins at the span and ends after two words.
    """
    back = F.reverse(before)
    back_unit = f"(?:{LABEL}*+{BODY}++|{LABEL}++)"
    one, two = (F.lower(F.reverse(F.regexp_extract(back, rf"^\s*+({back_unit})(?:\s*+({back_unit}))?", k))) for k in (1, 2))
    next_, over = (F.lower(F.regexp_extract(behind, rf"^(?:\s|{LABEL})*+({BODY}++{LABEL}*+)(?:\s*+({UNIT}))?", k)) for k in (1, 2))
    side = lambda mark, first, both, more: F.array(F.when(first != "", F.concat(F.lit(mark), first)), F.when(more != "", F.concat(F.lit(mark), both)))
    return F.filter(F.concat(side("<", one, F.concat_ws(" ", two, one), two), side(">", next_, F.concat_ws(" ", next_, over), over)), lambda w: w.isNotNull())


def free(tokens: Column, spans: Column) -> Column:
    """The tokens that overlap none of the spans: both in one sorted list, with the furthest end before and the next start behind."""
    event = lambda s, own: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(own).alias("own"), s["match"].alias("match"), s["context"].alias("context"))
    events = F.array_sort(F.concat(F.transform(spans, lambda s: event(s, 0)), F.transform(tokens, lambda t: event(t, 1))))
    reach = running_maxima(F.transform(events, lambda e: F.when(e["own"] == 0, e["end"]).otherwise(F.lit(0).cast("bigint"))))
    # starts are not negative: the largest of -1 - start from the right is the next start
    ahead = F.reverse(running(F.reverse(F.transform(events, lambda e: F.when(e["own"] == 0, -1 - e["start"]).otherwise(F.lit(-(1 << 62)).cast("bigint")))), larger, -(1 << 62)))
    marked = F.arrays_zip(events.alias("e"), reach.alias("reach"), ahead.alias("ahead"))
    kept = F.filter(marked, lambda z: (z["e"]["own"] == 1) & (z["reach"] <= z["e"]["start"]) & (-1 - z["ahead"] >= z["e"]["end"]))
    return F.transform(kept, lambda z: F.struct(z["e"]["start"].alias("start"), z["e"]["end"].alias("end"), z["e"]["match"].alias("match"), z["e"]["context"].alias("context")))


SPAN = "array<struct<start:bigint,end:bigint,match:string,context:array<string>>>"


def spans_of(docs: DataFrame, kind: str, pattern: str, present: Column) -> DataFrame:
    """Add a column kind of all matches of pattern in text; present is a cheap test that there can be any."""
    docs = docs.withColumns({
        "_m": F.when(present, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))),
        "_p": F.when(present, F.split("text", pattern, -1)),
    })
    docs = docs.withColumn("_e", F.when(F.size("_m") > 0, running_sums(F.transform("_m", lambda x, i: (F.length(x) + F.length(F.get("_p", i))).cast("bigint")))))
    found = F.transform("_m", lambda x, i: F.struct((F.get("_e", i) - F.length(x)).alias("start"), F.get("_e", i).alias("end"), x.alias("match"), contexts(F.get("_p", i), F.get("_p", i + 1)).alias("context")))
    return docs.withColumn(kind, F.coalesce(F.when(F.size("_m") > 0, found), F.array()).cast(SPAN)).drop("_m", "_p", "_e")


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, the base spans of each kind, and the identifier-like tokens that overlap none of them."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_d", F.col("text").rlike("[0-9]"))
    present = {"email": F.col("text").contains("@"), "ip": F.col("_d"), "card": F.col("_d"), "phone": F.col("_d") & F.col("text").contains("+")}
    for kind in KINDS:
        rows = spans_of(rows, kind, PATTERNS[kind], present[kind])
    rows = spans_of(rows, "token", TOKEN, F.col("_d"))
    checked = lambda k: F.filter(k, lambda s: valid(k, s["match"]))
    rows = rows.withColumns({k: checked(k) for k in KINDS}).withColumn("_all", F.concat(*KINDS))
    # a full stop or dash behind a token is not part of it
    trimmed = F.transform("token", lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(F.rtrim(s["match"], F.lit("._-/+")))).alias("end"), F.rtrim(s["match"], F.lit("._-/+")).alias("match"), s["context"].alias("context")))
    rows = rows.withColumn("token", trimmed)
    rows = rows.withColumn("token", F.filter("token", lambda t: F.length(t["match"]) >= 5))
    rows = rows.withColumn("token", F.when((F.size("token") > 0) & (F.size("_all") > 0), free(F.col("token"), F.col("_all"))).otherwise(F.col("token")))
    return rows.select("row", "doc_id", *KINDS, "token")


def bootstrap(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """Accepted instances: a column instance."""
    spark = docs.sparkSession
    mention = lambda c, seed: scanned.select(F.explode(c).alias("s")).select(F.explode("s.context").alias("pattern"), F.col("s.match").alias("instance"), F.lit(seed).alias("seed"))
    mentions = mention(F.concat(*KINDS), True).unionByName(mention(F.col("token"), False))
    found = materialize(mentions.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("known")), "mentions")

    # a pattern of fewer instances can never have MIN_KNOWN known ones; one that never stands as words of its own has no share
    able = materialize(found.groupBy("pattern").agg(F.count("*").alias("c")).where(F.col("c") >= MIN_KNOWN).select("pattern", F.substring("pattern", 2, (1 << 31) - 1).alias("said")), "patterns")
    # one pass counts every word, and the pairs that are patterns beside the word alone
    pair = able.where("said like '% %'").select(F.substring_index("said", " ", 1).alias("two"), F.substring_index("said", " ", -1).alias("one"), F.lit(True).alias("able")).distinct()
    words = F.regexp_extract_all(F.lower("text"), F.lit(UNIT), F.lit(0))
    pairs = docs.select(words.alias("w")).select(F.explode(F.transform("w", lambda w, i: F.struct(w.alias("one"), F.coalesce(F.get("w", i - 1), F.lit("")).alias("two")))).alias("p")).select("p.one", "p.two", F.lit(1).cast("long").alias("n"))
    if pair.count() <= MOST_PAIRS:
        met = pairs.join(F.broadcast(pair), ["one", "two"], "left")
    else:
        met = pairs.groupBy("one", "two").agg(F.sum("n").alias("n")).join(merge(pair), ["one", "two"], "left")
    met = materialize(met.groupBy("one", F.when(F.col("able"), F.col("two")).alias("two")).agg(F.sum("n").alias("n")), "words")
    counted = met.select(F.col("one").alias("said"), "n").unionByName(met.where("two is not null").select(F.concat_ws(" ", "two", "one").alias("said"), "n"))
    total = materialize(counted.groupBy("said").agg(F.sum("n").alias("total")).join(able, "said").drop("said"), "occurrences")
    graph = materialize(found.join(total, "pattern"), "graph0")
    accepted, k = spark.createDataFrame([], "instance string"), 0
    while True:
        known = graph.where("known").groupBy("pattern", "total").agg(F.count("*").alias("known"), F.sum("n").alias("hits"))
        trusted = known.where(F.col("known") >= MIN_KNOWN).withColumn("p", F.least(F.lit(1.0), F.col("hits") / F.col("total"))).where(F.col("p") >= MIN_PATTERN).select("pattern", "p")
        belief = graph.where("not known").join(trusted, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-6)))))).alias("belief"))
        new = materialize(belief.where(F.col("belief") >= MIN_INSTANCE).select("instance"), f"accepted{k}")
        if new.isEmpty():
            return accepted.distinct()
        accepted, k = accepted.unionByName(new), k + 1
        after = materialize(graph.join(new.withColumn("new", F.lit(True)), "instance", "left").withColumn("known", F.col("known") | F.col("new").isNotNull()).drop("new"), f"graph{k}")
        forget(graph)
        graph = after


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def labelled(kind: str, spans: str | Column) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def find_pii(docs: DataFrame) -> DataFrame:
    """A row for each document row: row, doc_id, base and added (arrays of kind, start, end), in order of kind and start."""
    docs = docs.select("doc_id", "text")
    scanned = materialize(scan(docs), "scan")
    accepted = bootstrap(docs, scanned)
    tokens = scanned.select("row", F.explode("token").alias("t")).select("row", "t.start", "t.end", F.col("t.match").alias("instance"))
    added = tokens.join(accepted, "instance").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("extra"))
    base = F.concat(*(labelled(k, k) for k in KINDS))
    return scanned.select("row", "doc_id", base.alias("base")).join(added, "row", "left").select("row", "doc_id", "base", F.coalesce(labelled("id", "extra"), F.array()).cast("array<struct<kind:string,start:bigint,end:bigint>>").alias("added"))


def cut_out(blocks: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text that is cut into blocks of PIECE code points."""
    each = F.sequence(F.floor(start / PIECE), F.greatest(F.floor((end - 1) / PIECE), F.floor(start / PIECE)))
    inside = lambda b: F.substring(F.get(blocks, b.cast("int")), (F.greatest(start - b * PIECE, F.lit(0)) + 1).cast("int"), (F.least(end - b * PIECE, F.lit(PIECE)) - F.greatest(start - b * PIECE, F.lit(0))).cast("int"))
    return F.when(end > start, F.array_join(F.transform(each, inside), "")).otherwise("")


def redacted(text: Column, spans: Column) -> Column:
    """text with each span (start, end, kind; sorted) replaced by its kind; where two overlap, the later covers what the earlier left."""
    ends = F.concat(F.array(F.lit(0).cast("bigint")), running_maxima(F.transform(spans, lambda s: s["end"])))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    packed = F.struct(blocks.alias("blocks"), ends.alias("ends"))

    def pieces(p: Column) -> Column:
        part = lambda s, i: F.when(s["end"] > F.get(p["ends"], i), F.concat(cut_out(p["blocks"], F.get(p["ends"], i), F.greatest(s["start"], F.get(p["ends"], i))), F.lit("["), s["kind"], F.lit("]"))).otherwise("")
        return F.concat(F.array_join(F.transform(spans, part), ""), cut_out(p["blocks"], F.element_at(p["ends"], -1), F.length(text).cast("bigint")))

    # by way of an array of one, so that blocks and ends are worked out once
    return F.transform(F.array(packed), pieces)[0]


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in square brackets, and n_chars brought up to date."""
    keyed, key = with_row_key(docs)
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans, row = unused(keyed, "_spans"), unused(keyed, "_row")
    body = keyed.select(F.col(key).alias("doc_id"), "text")
    found = last_only(docs.sparkSession, lambda: find_pii(body).select(F.col("doc_id").alias(row), ordered.alias(spans)).where(F.size(spans) > 0), "spans")
    clean = F.when(F.col(spans).isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col(spans)))
    both = keyed.join(found, F.col(key) == F.col(row), "left").withColumn("text", clean)
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return both.select(*(F.col(f"`{c}`") for c in docs.columns))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    columns = ["doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans")]
    return last_only(spark, lambda: find_pii(table(spark, sf_dir, "documents")).select(*columns), "personal")
