"""Personal data and what gives it away, with DataFrame operations only.

Base spans come from four patterns. The patterns are those of the contract in possessive form: the
same matches, but linear time and no recursion on very long runs of digits or letters.

Terms: an entity is a value found by a pattern, in lower case or by its digits. A term is a run of
letters and digits, in lower case. Over the texts that hold an entity, a term's co-occurrence with
it is counted; over the whole corpus, how often the term occurs at all. The pointwise mutual
information of entity and term, divided by the entity's own information, tells how much of the
entity the term discloses (1: whoever reads the term knows the entity). From ``generalise`` on, the
term's occurrences in texts with that entity become spans of kind ``term``, from ``remove`` on of
kind ``removed``. Few texts are weak evidence: the share of a term's occurrences that meet the
entity is discounted as if another ``doubt`` of a text had the term without the entity, beside the
distinct texts that have both. So entities of a single text are judged, too.

Rows: null texts have no spans; repeated rows and copies count as one text for evidence and as
several for frequencies. Null ids are carried along. Empty tables give none. Extra columns are kept
by ``sanitise`` and left out by ``find``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hibiki.llm.common import prepare
from hibiki.session import write_out

KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("term", "removed")
GENERALISE = 0.9
REMOVE = 0.97
#: Texts that each pair's distinct texts are discounted by.
DOUBT = 0.25

_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
# A match begins at a run's first character, or where the last match ended.
_PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORTH_A_LOOK = {  # what a text with a match must hold
    "email": lambda text: F.contains(text, F.lit("@")),
    "ip": lambda text: F.rlike(text, F.lit(r"[0-9]\.[0-9]")),
    "card": lambda text: F.rlike(text, F.lit(r"[0-9][\x20-]?[0-9]")),
    "phone": lambda text: F.contains(text, F.lit("+")),
}
_TERM = r"[\p{L}\p{M}\p{N}]+"
_SPAN = "array<struct<start:int,kind:int,stop:int>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(backwards, i, F.lit(1)).cast("int") * (2 - i % 2)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    count = F.length(_digits(value))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # Anything beyond an int is beyond 255, too.
        fits = lambda part: F.coalesce(part.try_cast("int") <= 255, F.lit(False))
        return F.forall(F.split(value, r"\."), fits)
    if kind == "card":
        return F.when(count.between(12, 19), _luhn(_digits(value))).otherwise(False)
    return count.between(9, 15)


def _located(text: Column, pattern: str, kind: Column | int, valid) -> Column:
    """Spans of the pattern's matches, in code points, end exclusive.

    The pieces between the matches and the matches alternate, so adding up their lengths gives
    each position in one pass.
    """
    parts = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))

    def step(done: Column, part: Column) -> Column:
        begin = done["at"] + F.length(part["gap"])
        end = begin + F.coalesce(F.length(part["match"]), F.lit(0))
        own = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("stop"))
        good = part["match"].isNotNull() & valid(part["match"])
        found = F.when(good, F.concat(done["found"], F.array(own))).otherwise(done["found"])
        return F.struct(end.alias("at"), found.cast(_SPAN).alias("found"))

    return F.aggregate(parts, start, step)["found"]


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind as listed."""
    found = [
        F.when(
            _WORTH_A_LOOK[kind](text),
            _located(text, _PATTERNS[kind], i, lambda m, kind=kind: _valid(kind, m)),
        ).otherwise(F.array().cast(_SPAN))
        for i, kind in enumerate(KINDS)
    ]
    return F.array_sort(F.coalesce(F.concat(*found), F.array().cast(_SPAN)))


def _entity(kind: Column, value: Column) -> Column:
    """The same for all spellings of a value."""
    own = (
        F.when(kind == KINDS.index("email"), F.lower(value))
        .when(kind == KINDS.index("ip"), F.regexp_replace(value, r"(?<![0-9])0+(?=[0-9])", ""))
        .otherwise(_digits(value))
    )
    return F.struct(kind.alias("kind"), own.alias("value"))


def _disclosing(
    hits: DataFrame, docs: DataFrame, rows: int, text: str, generalise: float, remove: float,
    doubt: float,
) -> DataFrame:
    """(_hash, term, kind): terms of a text that disclose one of its entities too far.

    ``hits``: distinct texts (_hash, _text, _spans, copies) with base spans. Entities that the same
    texts hold are judged as one (g, h: hashes of that set), so that a text with many values of its
    own does not pair each with every word.
    """
    value = lambda s: _entity(
        s["kind"], F.substring(F.col("_text"), s["start"] + 1, s["stop"] - s["start"])
    )
    held = hits.select(
        "_hash", "copies", F.explode(F.array_distinct(F.transform("_spans", value))).alias("entity")
    )
    known = held.groupBy("entity").agg(
        F.sum("copies").alias("n_e"), F.bit_xor(F.xxhash64("_hash")).alias("g"),
        F.bit_xor(F.xxhash64(F.lit("h"), "_hash")).alias("h"),
    )
    known = write_out(known.filter(F.col("n_e") < rows), "entities")
    holders = write_out(
        held.join(known, "entity").select("_hash", "copies", "g", "h", "n_e").distinct(), "holders"
    )
    words = hits.select("_hash", F.array_distinct(_terms(F.col("_text"))).alias("terms"))
    most = holders.groupBy("_hash").agg(F.max("n_e").alias("n_e"))
    terms = (
        most.join(words, "_hash").select("n_e", F.explode("terms").alias("term"))
        .groupBy("term").agg(F.max("n_e").alias("most"))
    )
    terms = write_out(terms, "terms")
    # Without entities there is nothing to ask the corpus. Counts are summed in each task before
    # the shuffle, in the same way at every size.
    heard = (docs.limit(0) if terms.isEmpty() else docs).select(
        F.explode(F.array_distinct(_terms(F.coalesce(F.col(text), F.lit(""))))).alias("term")
    )
    frequency = heard.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(terms, "term")
    # Terms too frequent to disclose any entity they meet are few, but most of what is spoken.
    bound = 1 + F.log2(F.least("most", "n_t") / F.col("n_t")) / F.log2(F.lit(float(rows)))
    frequency = frequency.filter(bound >= generalise - 1e-9).select("term", "n_t")
    frequency = write_out(frequency, "frequency")
    spoken = (
        words.select("_hash", F.explode("terms").alias("term")).join(frequency, "term", "left_semi")
        .join(holders, "_hash").select("_hash", "copies", "g", "h", "n_e", "term")
    )
    spoken = write_out(spoken, "spoken")
    pairs = spoken.groupBy("g", "h", "term").agg(
        F.sum("copies").alias("n_et"), F.count(F.lit(1)).alias("texts"), F.any_value("n_e").alias("n_e")
    )
    certain = F.col("texts") / (F.col("texts") + doubt)
    share = F.log2(F.col("n_et") / F.col("n_t") * certain) / F.log2(F.lit(float(rows)) / F.col("n_e"))
    told = (
        pairs.join(frequency, "term")
        .withColumn("share", 1 + share).filter(F.col("share") >= generalise)
        .select("g", "h", "term", F.when(F.col("share") >= remove, len(KINDS) + 1)
                .otherwise(len(KINDS)).alias("kind"))
    )
    return spoken.join(told, ["g", "h", "term"]).select("_hash", "term", "kind")


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def _term_spans(hits: DataFrame, disclosing: DataFrame) -> DataFrame:
    """(_hash, terms): spans of disclosing terms in each distinct text, apart from base spans."""
    wanted = (
        disclosing.groupBy("_hash", "term").agg(F.max("kind").alias("kind"))
        .groupBy("_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("wanted"))
    )
    own = hits.join(wanted, "_hash")
    # Words are located in the text as it is; lower-casing may change its length.
    asked = lambda m: F.map_contains_key(F.col("wanted"), F.lower(m))
    located = own.select("_hash", "_text", "_spans", "wanted",
                         _located(F.col("_text"), _TERM, -1, asked).alias("words"))
    word = lambda s: F.element_at(
        F.col("wanted"), F.lower(F.substring(F.col("_text"), s["start"] + 1, s["stop"] - s["start"]))
    )
    marked = F.transform("words", lambda s: F.struct(
        s["start"].alias("start"), word(s).alias("kind"), s["stop"].alias("stop")
    ))
    apart = lambda s: s["kind"].isNotNull() & ~F.exists(
        F.col("_spans"), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])
    )
    return located.select("_hash", F.filter(marked, apart).alias("terms"))


def add_spans(
    docs: DataFrame, text: str = "text", generalise: float = GENERALISE, remove: float = REMOVE,
    doubt: float = DOUBT,
) -> DataFrame:
    """The columns of docs, ``_base`` and ``_terms``: spans of either sort."""
    prepare(docs.sparkSession)
    marked = docs.withColumn("_base", base_spans(F.col(text)))
    found = marked.filter(F.size("_base") > 0).withColumn("_hash", F.md5(F.col(text)))
    found = write_out(found, "base-spans")
    hits = write_out(
        found.groupBy("_hash").agg(F.any_value(text).alias("_text"), F.any_value("_base").alias("_spans"),
                                   F.count(F.lit(1)).alias("copies")),
        "texts-with-spans",
    )
    rows = docs.count()
    terms = _term_spans(hits, _disclosing(hits, docs, rows, text, generalise, remove, doubt))
    none = F.array().cast(_SPAN)
    with_terms = found.join(write_out(terms, "term-spans"), "_hash", "left").select(
        *docs.columns, "_base", F.coalesce(F.col("terms").cast(_SPAN), none).alias("_terms")
    )
    # Found again rather than written with their texts, which are nearly all of the corpus.
    without = marked.filter(F.size("_base") == 0).select(*docs.columns, "_base", none.alias("_terms"))
    return without.unionByName(with_terms)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, *TERM_KINDS)])
    one = lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string")
    )
    return F.array_join(F.transform(spans, one), ",")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", **thresholds) -> DataFrame:
    """Per row: its key, ``base`` spans and ``spans``, all of them, in order."""
    spans = add_spans(docs.select(F.col(key).alias("_key"), F.col(text).alias("_own")), "_own", **thresholds)
    every = F.array_sort(F.concat("_base", "_terms"))
    return spans.select(F.col("_key").alias(key), F.col("_base").alias("base"), every.alias("spans"))


def sanitise(docs: DataFrame, text: str = "text", **thresholds) -> DataFrame:
    """The rows with base spans and disclosing terms replaced by their kind, or removed."""
    # Columns are carried in a struct, so that none can clash.
    carried = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col(text).alias("_own"))
    marked = add_spans(carried, "_own", **thresholds)
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")], F.lit(""))
    own = F.col("_own")

    def step(done: Column, s: Column) -> Column:
        fresh = s["start"] >= done["at"]
        gap = F.substring(own, done["at"] + 1, s["start"] - done["at"])
        return F.struct(
            F.greatest(done["at"], s["stop"]).alias("at"),
            F.when(fresh, F.concat(done["out"], gap, F.get(marks, s["kind"]))).otherwise(done["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = lambda done: F.concat(done["out"], F.substring(own, done["at"] + 1, F.length(own)))
    every = F.array_sort(F.concat("_base", "_terms"))
    clean = F.when(F.size(every) > 0, F.aggregate(every, start, step, rest)).otherwise(own)
    kept = [clean.alias(c) if c == text else F.col(f"_row.`{c}`") for c in docs.columns]
    return marked.select(*kept)
