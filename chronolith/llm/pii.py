"""Information-theoretic sanitisation, in DataFrame expressions alone.

Patterns find the protected entities: e-mail addresses, network addresses, card and phone numbers. Over the whole corpus, the
normalised pointwise mutual information of a word and an entity, by the documents in which they occur, alone and together, tells
how far the word reveals the entity. In the documents that hold the entity, words over the disclosure thresholds are generalised or
removed, wherever they stand, along with the entities.

Co-occurrence is counted by whole documents, without a window. What makes that affordable loses nothing: an entity or word of one
document tells nothing; a word too common for the share that the commonest entity could give it is left out; and entities that
stand in the same documents are one class, as are words, so that a list of addresses in two texts is counted like one address.
Texts cost about their length, however many entities they hold: prefix sums go in two levels, texts are cut where the patterns cut them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import let, running, stored, table, whole

#: The kinds in their order, and the patterns as Java reads them fast: they begin where a match must begin, give nothing back
#: where nothing can be gained, and bound the digits of a card, so that long runs cost their length only.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])(?![ -][0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
ANY_HINT = r"@|[0-9][. -]?[0-9]|\+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP_OK = rf"^{OCTET}(?:\.{OCTET}){{3}}$"
#: Letters of a word at least.
WORD = 2
#: A run of letters, or all of what stands between white space and holds an @, which is dropped: only so can a word lie in an address.
WORDS = rf"(?<!\S)[^\s@]*+@\S*+|(?<!\p{{L}})\p{{L}}{{{WORD},}}+"
#: Documents (not all of one text) in which word and entity meet at least; information shares from which a word is generalised, and removed.
SUPPORT, GENERALISE, REMOVE = 2, 0.8, 0.95
#: Rows of candidate words, and of told pairs, up to which they are broadcast; beyond, an ordinary join.
BROADCAST_MOST = 500_000
#: Code points of the pieces in which a text is held while it is rewritten.
PIECE = 4096

FOUND = "array<struct<k:int,s:int,e:int,v:string>>"


def matches(text: Column, pattern: str) -> Column:
    """array of (s, e, v) of the leftmost non-overlapping matches, in code points, between the pieces that a split leaves."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    row = lambda z, starts: F.transform(z.m, lambda m, i: F.struct(F.get(starts, i).alias("s"), (F.get(starts, i) + F.length(m)).alias("e"), m.alias("v")))
    steps = lambda z: F.transform(z.m, lambda m, i: F.length(F.get(z.p, i)) + F.when(i > 0, F.length(F.get(z.m, i - 1))).otherwise(0))
    return let(both, lambda z: let(running(steps(z), lambda a, b: a + b), lambda starts: row(z, starts)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of value pass Luhn's test."""
    number = F.reverse(digits(value))
    digit = lambda i: F.substring(number, i, 1).cast("int")
    worth = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda n, i: n + worth(i)) % 10 == 0


#: What a match must pass to count, by kind.
PASSES = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.v.rlike(IP_OK),
    "card": lambda m: luhn(m.v),
    "phone": lambda m: F.length(digits(m.v)).between(9, 15),
}


def _of_kind(text: Column, k: int, kind: str) -> Column:
    """array of (k, s, e, v)."""
    kept = F.filter(matches(text, PATTERNS[kind]), PASSES[kind])
    return F.transform(kept, lambda m: F.struct(F.lit(k).alias("k"), m.s.alias("s"), m.e.alias("e"), m.v.alias("v")))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), base (spans of the four kinds, by kind and start), words (term, capital, s, e of every word of a text
    with a base span) of every document."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").cast("string").alias("text"))
    kinds = [F.when(text.rlike(HINTS[kind]), _of_kind(text, k, kind)).otherwise(F.expr(f"cast(array() as {FOUND})")) for k, kind in enumerate(KINDS[:4])]
    cut = rows.select("doc_id", "text", F.concat(*kinds).alias("base"))
    one = lambda m: F.struct(F.lower(m.v).alias("term"), (F.substring(m.v, 1, 1) != F.lower(F.substring(m.v, 1, 1))).alias("capital"), m.s.alias("s"), m.e.alias("e"))
    words = F.transform(F.filter(matches(text, WORDS), lambda m: ~F.contains(m.v, F.lit("@"))), one)
    no_words = F.expr("cast(array() as array<struct<term:string,capital:boolean,s:int,e:int>>)")
    return cut.select("doc_id", F.xxhash64("text").alias("h"), "base", F.when(F.size("base") > 0, words).otherwise(no_words).alias("words"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_MOST else df


def classes(held: DataFrame, name: str, *more: str) -> DataFrame:
    """name, its class (the least of those that stand in the same rows), n (its rows), of the names in held (row, h, name) that stand in
    SUPPORT rows of two texts at least. Rows are told apart by two hashes of all of them; names of unequal `more` columns are never one class."""
    least = F.min("h") != F.max("h")
    sums = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.shiftrightunsigned(F.xxhash64("row", F.lit(1)), 33)).alias("y"), least.alias("many")]
    of_name = stored(held.groupBy(name, *more).agg(*sums).where(F.col("many") & (F.col("n") >= SUPPORT)), f"pii-{name}")
    named = of_name.groupBy("n", "x", "y", *more).agg(F.min(name).alias(f"{name}_class"))
    return of_name.join(named, ["n", "x", "y", *more]).select(name, f"{name}_class", "n", *more)


def disclosures(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the rows of spans (row, h, base, words): row, entity_class of those with a class; row, term, term_class, s, e, capital of the words
    that may be told; and entity_class, term_class, share of those told, with a share of GENERALISE at least.

    Counts are of rows of docs, over the whole table: of those with the entity, of those with the word anywhere as a run of letters, and
    of those with both."""
    total = max(spans.count(), 1)
    held = spans.select("row", "h", F.explode(F.array_distinct(F.transform("base", lambda b: F.lower(b.v)))).alias("entity"))
    entities = stored(classes(held, "entity"), "pii-entities")
    most = entities.agg(F.max("n")).first()[0] or 0
    # with n rows a word's share is at least GENERALISE only up to total^(1 - GENERALISE) * n^GENERALISE rows of the other, were all of n among them
    widest = lambda n: F.pow(F.lit(float(total)), 1 - GENERALISE) * F.pow(n.cast("double"), GENERALISE) + 0.5
    of_entity = stored(held.join(_small(entities), "entity").where(F.col("entity") == F.col("entity_class")).select("row", "h", "entity_class", F.col("n").alias("n_entity")), "pii-held")
    words = spans.join(of_entity.select("row").distinct(), "row", "left_semi").select("row", "h", F.explode("words").alias("w")).select("row", "h", "w.*")
    terms = docs.select(F.explode(F.array_distinct(F.split(F.lower(whole("text")), r"[^\p{L}]+"))).alias("term")).where(F.length("term") >= WORD)
    counted = terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).where((F.col("n_term") >= SUPPORT) & (F.col("n_term") <= widest(F.lit(most))))
    words = stored(words.join(_small(stored(counted, "pii-counted")), "term"), "pii-words")
    # a word's rows are counted once
    meets = words.groupBy("row", "h", "term", "n_term").agg(F.min("s").alias("s")).select("row", "h", "term", "n_term")
    by_term = stored(classes(meets, "term", "n_term"), "pii-terms")
    words = words.join(by_term.select("term", "term_class"), "term")
    once = words.where(F.col("term") == F.col("term_class")).select("row", "term_class", "n_term").distinct()
    near = (F.col("n_term") <= widest(F.col("n_entity"))) & (F.col("n_entity") <= widest(F.col("n_term")))
    both = of_entity.join(once, "row").where(near).groupBy("entity_class", "term_class", "n_entity", "n_term")
    both = both.agg(F.count(F.lit(1)).alias("n_both"), (F.min("h") != F.max("h")).alias("many")).where(F.col("many") & (F.col("n_both") >= SUPPORT))
    joint = F.col("n_both") / F.lit(float(total))
    information = F.log2(joint / (F.col("n_term") / F.lit(float(total)) * F.col("n_entity") / F.lit(float(total))))
    share = F.when(joint < 1, information / -F.log2(joint)).otherwise(0.0)
    told = both.select("entity_class", "term_class", share.alias("share")).where(F.col("share") >= GENERALISE)
    return of_entity.select("row", "entity_class"), words, stored(told, "pii-told")


NO_TERMS = "cast(array() as array<struct<s:int,e:int,share:double,capital:boolean>>)"


def protected(docs: DataFrame) -> DataFrame:
    """doc_id, h, base, terms (array of s, e, share, capital) for every row of docs.

    A null text counts as empty. Rows that repeat give a row each; other columns are ignored; an empty table gives no rows. A word told
    by several entities has its greatest share.
    """
    spans = stored(found(docs).withColumn("row", F.monotonically_increasing_id()), "pii")
    held, words, told = disclosures(docs, spans)
    who = held.join(_small(told), "entity_class").groupBy("row", "term_class").agg(F.max("share").alias("share"))
    at = words.join(who, ["row", "term_class"])
    terms = at.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("s", "e", "share", "capital"))).alias("terms"))
    return spans.join(terms, "row", "left").select("doc_id", "h", "base", F.coalesce("terms", F.expr(NO_TERMS)).alias("terms"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x.k + 1), x.s, x.e)), ",")


def rewritten(text: Column, edits: Column) -> Column:
    """text with its edits (s, e, to), sorted, said instead; of edits that overlap the first is said, and all they cover goes."""
    held = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))

    def between(pieces: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / PIECE).cast("int")
        last = F.floor((b - 1) / PIECE).cast("int")
        joined = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
        return F.when(b > a, F.substring(joined, a - first * PIECE + 1, b - a)).otherwise("")

    def said(z: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(z.ends, i - 1)).otherwise(0)
        parts = F.transform(z.edits, lambda x, i: F.concat(between(z.pieces, before(i), x.s), F.when(x.s >= before(i), x.to).otherwise("")))
        return F.concat(F.array_join(parts, ""), between(z.pieces, F.element_at(z.ends, -1), z.n))

    # element_at, unlike get, may not be asked for the last of none: texts without an edit stay
    z = let(edits, lambda es: F.struct(es.alias("edits"), running(F.transform(es, lambda x: x.e), lambda a, b: F.greatest(a, b)).alias("ends"), held.alias("pieces"), F.length(text).alias("n")))
    return F.when(F.size(edits) > 0, let(z, said)).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with their texts rewritten: entities become [EMAIL], [IP], [CARD] or [PHONE], generalised words [NAME], if they begin with a capital, or [WORD],
    removed words go.

    All columns stay, whatever their names, and a null text stays null. Rows that repeat are rewritten alike and all stay; an empty table
    stays empty. Only texts with something that may be an entity are shuffled.
    """
    names = docs.columns
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:4]])
    base = F.transform("base", lambda b: F.struct(b.s.alias("s"), b.e.alias("e"), F.element_at(labels, b.k + 1).alias("to")))
    terms = F.transform("terms", lambda t: F.struct(t.s.alias("s"), t.e.alias("e"), F.when(t.share >= REMOVE, "").when(t.capital, "[NAME]").otherwise("[WORD]").alias("to")))
    # equal rows have equal spans, so any one of them will do
    edits = protected(docs).where(F.size("base") > 0).groupBy("doc_id", "h").agg(F.first(F.sort_array(F.concat(base, terms))).alias("edits")).select(F.col("doc_id").alias("id"), F.col("h").alias("hash"), "edits")
    maybe = F.coalesce(F.col("text").rlike(ANY_HINT), F.lit(False))
    own = docs.where(maybe).select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).withColumn("h", F.xxhash64(F.col("row.text").cast("string")))
    joined = own.join(edits, own["row.doc_id"].cast("long").eqNullSafe(edits.id) & (own.h == edits.hash), "left")
    text = F.when(F.col("edits").isNull(), F.col("row.text")).otherwise(rewritten(F.col("row.text").cast("string"), F.col("edits")))
    changed = joined.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names])
    return docs.where(~maybe).unionByName(changed)


def query(spark, sf_dir: str) -> DataFrame:
    spans = protected(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda b: b.k == k)).cast("long")
    terms = F.transform("terms", lambda t: F.struct(F.lit(4).alias("k"), t.s.alias("s"), t.e.alias("e"), F.lit("").alias("v")))
    return spans.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", terms)).alias("spans"))
