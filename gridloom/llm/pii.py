"""Personal data: patterns for entities, and information-theoretic sanitisation, with DataFrame functions only.

Entities (e-mail and IP addresses, card and phone numbers) are found by patterns; the host of an e-mail address and the network of
an IP address are entities as well.  The method then asks which terms give an entity away: over the whole corpus it counts in how
many documents a term stands together with an entity, how many documents have the term, and how many the entity.  Copies of a text
count as one document: what only copies repeat is no evidence.  A term is disclosing if it was seen with the entity in at least
``MIN_SUPPORT`` documents, the entity is at least ``GENERALISE`` likely given the term, and knowing the term tells at
least the share ``MIN_SHARE`` of the entity's own information, -log2 P(entity), so that frequent entities count as well.
Disclosing terms are generalised to their class (``[NUMBER]``, ``[CODE]``, ``[NAME]``, ``[WORD]``), from ``REMOVE`` on
removed, wherever they stand in a document that holds the entity.  Terms are whole words of any length that touch no entity.

Scale: texts are read once; what is kept of each row is its entities and distinct terms, and its text if it has an entity.
Only entities and terms in ``MIN_SUPPORT`` documents at least are looked at, and a term only with entities frequent enough to be as
likely as ``GENERALISE`` given it.  Entities of the same documents are one class, and so are terms; pairs of classes are counted,
combined before their exchange, so documents that repeat a long list of names and addresses cost in proportion to it.  A frequent
entity or term is one key of an aggregate, and the joins that bring counts to documents may be split by adaptive execution.  Terms are
marked by an equi-join of the words of the documents that hold disclosing ones.

Positions come from splitting a text at its matches: lengths of the parts are summed within blocks and over them, so the work is
in proportion to the text.

Defined cases: null text counts as empty; each row has its result, whatever its id; rows that repeat a text share it and are one document of the counts;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WS, let, materialise, spread_join, text_or_empty, words_of

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
# The base patterns, with possessive loops and a guard that a match starts where its run of characters does (or where
# the match before it ended), so that no text makes them quadratic.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATES = {
    "email": lambda t: F.instr(t, "@") > 0,
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"(?:[0-9][\x20-]?){11}[0-9]"),
    "phone": lambda t: F.instr(t, "+") > 0,
}
MIN_SUPPORT = 3
MIN_SHARE = 0.5
GENERALISE, REMOVE = 0.5, 0.9
BLOCK = 256
#: Code points of the pieces, and of their pieces, in which entities are masked.
PIECES = (65536, 2048)
#: Bitmaps of rows that are broadcast, 16 MB of them; more rows are joined.
BITMAPS = 4096

_SPAN = "struct<start:int,stop:int,text:string>"
#: Stands for the characters of entities; a control character, which a word may hold but no term needs.
_MASK = "\x01"


def _ends(lengths: Column) -> Column:
    """Running sums of an array of ints: within blocks, then over the blocks."""
    none = F.array().cast("array<int>")

    def last(x: Column) -> Column:
        return F.get(x, F.size(x) - 1)

    def plain(x: Column) -> Column:
        return F.aggregate(x, none, lambda out, y: F.concat(out, F.array(F.coalesce(last(out), F.lit(0)) + y)))

    def within(x: Column, levels: int) -> Column:
        if not levels:
            return plain(x)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: plain(F.slice(x, b * BLOCK + 1, F.lit(BLOCK))))

        def shifted(parts: Column) -> Column:
            sums = let(F.transform(parts, last), lambda y: within(y, levels - 1))
            return let(sums, lambda z: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda y: y + F.coalesce(F.get(z, i - 1), F.lit(0))))))

        return let(blocks, shifted)

    return F.when(F.size(lengths) == 0, none).otherwise(let(lengths, lambda x: F.when(F.size(x) <= BLOCK, plain(x)).otherwise(within(x, 1))))


def spans_of(text: Column, pattern: str) -> Column:
    """All matches of a pattern: array of (start, stop, text), in code points, stop exclusive."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))

    def place(m: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        # gap and match lengths in turn: the ends of the matches are the running sums at them
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: F.length(g) + F.length(x))
        return let(
            _ends(lengths),
            lambda e: F.zip_with(
                m, e, lambda x, stop: F.struct((stop - F.length(x)).alias("start"), stop.alias("stop"), x.alias("text"))
            ),
        )

    none = F.array().cast(f"array<{_SPAN}>")
    return let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(place(m)))


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return x.rlike(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{0,2})){3}$")
    if kind == "card":
        digits = F.translate(x, " -", "")
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(x, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Entities: array of (start, rank of the kind, stop, text), by start, then kind."""
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,text:string>>")

    def of_kind(rank: int, kind: str) -> Column:
        good = F.filter(spans_of(text, PATTERNS[kind]), lambda s: _valid(kind, s["text"]))
        one = F.transform(
            good,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(rank).alias("kind"), s["stop"].alias("stop"), s["text"].alias("text")
            ),
        )
        return F.when(GATES[kind](text), one).otherwise(none)

    parts = [of_kind(rank, kind) for rank, kind in enumerate(KINDS[:4])]
    return F.sort_array(F.concat(*parts))


def term_of(word: Column) -> Column:
    """A word as a term: lower case, without punctuation at its ends."""
    return F.lower(F.regexp_replace(word, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", ""))


def entity_of(s: Column) -> Column:
    """A span's entity: kind and text in lower case, of cards and phones the digits."""
    return F.concat_ws(":", s["kind"].cast("string"), F.lower(F.when(s["kind"] >= 2, F.regexp_replace(s["text"], "[^0-9]", "")).otherwise(s["text"])))


def masked(text: Column, spans: Column) -> Column:
    """The text with every character of a span replaced by ``_MASK``, and no other ``_MASK`` in it.

    A place is found by going through the text from its start, so a text is cut into pieces that have spans of their own.
    """
    state = "struct<at:int,out:array<string>>"

    def whole(x: Column, spans: Column) -> Column:
        def cut(a: Column, s: Column) -> Column:
            free = F.substring(x, a["at"] + 1, s["start"] - a["at"])
            blank = F.repeat(F.lit(_MASK), s["stop"] - F.greatest(a["at"], s["start"]))
            more = F.array(F.when(s["start"] > a["at"], free).otherwise(F.lit("")), blank)
            out = F.when(s["stop"] <= a["at"], a["out"]).otherwise(F.concat(a["out"], more))
            return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), out.alias("out")).cast(state)

        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(state)
        return F.aggregate(spans, none, cut, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(x, a["at"] + 1, F.lit(2**31 - 1))))

    def pieces(x: Column, spans: Column, sizes: tuple[int, ...]) -> Column:
        if not sizes:
            return whole(x, spans)
        size, *rest = sizes

        def piece(x: Column, i: Column) -> Column:
            low = i * size
            held = F.filter(spans, lambda s: (s["stop"] > low) & (s["start"] < low + size))
            own = F.transform(held, lambda s: F.struct(F.greatest(s["start"] - low, F.lit(0)).alias("start"), F.least(s["stop"] - low, F.lit(size)).alias("stop")))
            return let(own, lambda own: F.when(F.size(own) == 0, x).otherwise(pieces(x, own, rest)))

        return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), piece), "")

    return F.when(F.size(spans) == 0, text).otherwise(pieces(F.translate(text, _MASK, " "), spans, PIECES))


def free_terms(text: Column, spans: Column) -> Column:
    """The distinct terms of the words that touch no span."""
    free = let(masked(text, spans), lambda x: F.filter(words_of(x), lambda w: ~F.contains(w, F.lit(_MASK))))
    words = F.when(F.size(spans) == 0, words_of(text)).otherwise(free)
    return F.filter(F.array_distinct(F.transform(words, term_of)), lambda x: x != "")


def class_of(word: Column) -> Column:
    """What a disclosing word is generalised to."""
    digit, letter = word.rlike(r"\p{Nd}"), word.rlike(r"\p{L}")
    return (
        F.when(digit & ~letter, "[NUMBER]").when(digit, "[CODE]").when(word.rlike(r"^[\p{P}\p{S}]*\p{Lu}"), "[NAME]").otherwise("[WORD]")
    )


def entities_of(s: Column) -> Column:
    """A span's entity, and what it is one of: the host of an e-mail address, the network (three parts) of an IP address."""
    one = entity_of(s)
    host = F.concat(F.lit("0@"), F.lower(F.substring_index(s["text"], "@", -1)))
    network = F.concat(F.lit("1/"), F.substring_index(s["text"], ".", 3))
    return F.when(s["kind"] == 0, F.array(one, host)).when(s["kind"] == 1, F.array(one, network)).otherwise(F.array(one))


def free_words(text: Column, spans: Column) -> Column:
    """The words that touch no span: array of (start, stop, text, term)."""
    words = let(masked(text, spans), lambda x: F.filter(spans_of(x, f"[^{WS}]++"), lambda w: ~F.contains(w["text"], F.lit(_MASK))))
    return F.transform(words, lambda w: F.struct(w["start"].alias("start"), w["stop"].alias("stop"), w["text"].alias("text"), term_of(w["text"]).alias("term")))


def among(df: DataFrame, kept: DataFrame, row: str) -> DataFrame:
    """The rows of ``df`` whose number is in ``kept`` (which has it once), without an exchange of ``df``: the numbers are dealt by buckets, a
    bitmap of 4 KB each, and up to ``BITMAPS`` of them go to every task; more are joined by number.

    Numbers are those of ``monotonically_increasing_id``: dense within each task, so a bucket is a stretch of up to 32,768 rows of one task.
    """
    bucket, place = F.bitmap_bucket_number(row), F.bitmap_bit_position(row)
    # dealt first: partial bitmaps of every task would be tasks times buckets
    dealt = kept.select(bucket.alias("__bucket"), place.alias("__at")).repartition("__bucket")
    maps = materialise(dealt.groupBy("__bucket").agg(F.bitmap_construct_agg("__at").alias("__bits")), "kept")
    if maps.count() > BITMAPS:
        return spread_join(df, kept, [row])
    byte = F.conv(F.hex(F.substring("__bits", F.call_function("div", place, F.lit(8).cast("long")).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.call_function("shiftright", byte, (place % 8).cast("int")) % 2 == 1
    return df.withColumn("__bucket", bucket).join(F.broadcast(maps), "__bucket").where(held).select(*df.columns)


class Sanitiser:
    """Entities and disclosing terms of one table."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.docs, self.text_col, self.id_col = docs, text_col, id_col
        read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("t"))
        read = read.withColumn("spans", base_spans(F.col("t")))
        entities = F.array_distinct(F.flatten(F.transform("spans", entities_of)))
        held = F.when(F.size("spans") > 0, F.col("t"))
        self.base = materialise(
            read.select("doc_id", "spans", entities.alias("entities"), free_terms(F.col("t"), F.col("spans")).alias("terms"),
                        held.alias("t"), F.substring(F.unhex(F.sha2("t", 256)), 1, 16).alias("h")).withColumn("row", F.monotonically_increasing_id()),
            "spans",
        )

    def disclosing(self) -> DataFrame:
        """(row, term, likelihood) for the texts that hold an entity which the term discloses; a row stands for all copies of its text.

        Copies of a text are one document.  Entities in the same documents are one class, as are terms in as many documents of which
        the same hold entities: only pairs of classes are counted, so a page of many addresses and names of its own that a few pages
        repeat costs in proportion to its length.
        """
        enough, key = F.count(F.lit(1)), ["f0", "f1"]
        prints = [F.bit_xor(F.xxhash64("row", F.lit(k))).alias(f"f{k}") for k in (0, 1)]
        once = materialise(self.base.select("h", "row").groupBy("h").agg(F.min("row").alias("row")), "texts")
        texts = among(self.base.select("row", "entities", "terms"), once.select("row"), "row")
        holding = texts.where(F.size("entities") > 0)

        # (row, class) of the entities and of the terms that may disclose
        holds = holding.select("row", F.explode("entities").alias("entity"))
        entities = holds.groupBy("entity").agg(enough.alias("with_entity"), *prints).where(F.col("with_entity") >= MIN_SUPPORT)
        held = spread_join(holds, entities, ["entity"]).select("row", *key, "with_entity").distinct()
        spoken = holding.select("row", F.explode("terms").alias("term"))
        terms = spoken.groupBy("term").agg(enough.alias("n"), *prints).where(F.col("n") >= MIN_SUPPORT)
        every = texts.select(F.explode("terms").alias("term")).groupBy("term").agg(enough.alias("with_term"))
        terms = materialise(terms.join(every, "term").select("term", F.col("f0").alias("g0"), F.col("f1").alias("g1"), "with_term"), "terms")
        said = materialise(spread_join(spoken, terms, ["term"]), "said")
        per_row = held.groupBy("row").agg(F.collect_list(F.struct(*key, "with_entity")).alias("es"))
        rows = spread_join(said.select("row", "g0", "g1", "with_term").distinct(), per_row, ["row"])
        # likelihood is with_entity / with_term at most
        able = F.filter("es", lambda e: e["with_entity"] >= GENERALISE * F.col("with_term"))
        pairs = rows.select("row", "g0", "g1", "with_term", F.explode(able).alias("e")).select("row", "g0", "g1", "with_term", "e.*")
        pairs = materialise(pairs, "pairs")
        both = [*key, "g0", "g1", "with_entity", "with_term"]
        known = pairs.groupBy(*both).agg(enough.alias("both")).where(F.col("both") >= MIN_SUPPORT)
        n = once.count()
        likely = F.col("both") / F.col("with_term")
        own = F.log2(F.lit(float(max(n, 1))) / F.col("with_entity"))
        told = (own > 0) & (own + F.log2(likely) >= MIN_SHARE * own)
        known = known.where((likely >= GENERALISE) & told).select(*both, likely.alias("likelihood"))
        hits = spread_join(pairs, known, both).groupBy("row", "g0", "g1", "with_term").agg(F.max("likelihood").alias("likelihood"))
        return spread_join(said, hits, ["row", "g0", "g1", "with_term"]).select("row", "term", "likelihood")

    def found(self) -> DataFrame:
        """One row per input row: row, doc_id, h, all spans (arrays of start, kind, stop, put)."""
        told = materialise(self.disclosing(), "disclosing")
        one = self.base.select("row", "h", "t", "spans").where(F.size("spans") > 0)
        words = spread_join(one, told.select("row").distinct(), ["row"]).select("row", "h", F.explode(free_words(F.col("t"), F.col("spans"))).alias("w"))
        words = words.select("row", "h", "w.*").where("term <> ''")
        put = F.when(F.col("likelihood") >= REMOVE, "").otherwise(class_of(F.col("text")))
        placed = spread_join(words, told, ["row", "term"]).select("h", F.struct("start", F.lit(4).alias("kind"), "stop", put.alias("put")).alias("s"))
        terms = placed.groupBy("h").agg(F.collect_list("s").alias("terms"))
        names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
        span = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"), F.get(names, s["kind"]).alias("put"))
        none = F.array().cast("array<struct<start:int,kind:int,stop:int,put:string>>")
        base = self.base.select("row", "doc_id", "h", F.transform("spans", span).alias("base"))
        base = spread_join(base, terms, ["h"], "left")
        return base.select("row", "doc_id", "h", F.sort_array(F.concat("base", F.coalesce("terms", none))).alias("every"))

    def report(self) -> DataFrame:
        """doc_id, counts by kind, digest of the base spans, all spans and the actions on terms as text."""
        names = F.array(*[F.lit(k) for k in KINDS])

        def text(spans: Column, name) -> Column:
            return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")

        def kind(s: Column) -> Column:
            return F.get(names, s["kind"])

        def count(rank: int, kind: str) -> Column:
            return F.size(F.filter("every", lambda s: s["kind"] == rank)).cast("long").alias(f"n_{kind}")

        counts = [count(rank, kind) for rank, kind in enumerate(KINDS[:4])]
        base, terms = F.filter("every", lambda s: s["kind"] < 4), F.filter("every", lambda s: s["kind"] == 4)
        acts = text(terms, lambda s: F.when(s["put"] == "", "remove").otherwise(F.concat(F.lit("generalise"), s["put"])))
        return self.found().select("doc_id", *counts, F.sha2(text(base, kind), 256).alias("base_sha256"), text(F.col("every"), kind).alias("spans"), acts.alias("actions"))

    def sanitised(self) -> DataFrame:
        """doc_id and text: entities replaced by their kind in brackets, terms generalised to their class or left out."""
        found = self.found().select(F.col("doc_id").alias("f_id"), F.col("h").alias("f_h"), "every").dropDuplicates(["f_id", "f_h"])
        read = self.docs.select(F.col(self.id_col).cast("long").alias("doc_id"), text_or_empty(self.text_col).alias("t"))
        joined = read.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.substring(F.unhex(F.sha2("t", 256)), 1, 16) == F.col("f_h")))
        state = "struct<at:int,out:array<string>>"

        # parts between spans and their replacements; of overlapping spans the first is replaced whole
        def step(a: Column, s: Column) -> Column:
            inside = F.struct(F.greatest(a["at"], s["stop"]).alias("at"), a["out"].alias("out"))
            parts = F.concat(a["out"], F.array(F.substring("t", a["at"] + 1, s["start"] - a["at"]), s["put"]))
            return F.when(s["start"] < a["at"], inside).otherwise(F.struct(s["stop"].alias("at"), parts.alias("out"))).cast(state)

        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(state)
        clean = F.aggregate("every", first, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring("t", a["at"] + 1, F.lit(2**31 - 1))))
        return joined.select("doc_id", clean.alias("text"))


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, actions of every row."""
    return Sanitiser(docs, id_col, text_col).report()
