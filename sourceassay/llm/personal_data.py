"""Operator 8, personal data: information-theoretic sanitisation, in DataFrame functions only.

Patterns find the protected entities (mail addresses, network addresses, card and phone numbers).  Blanking them is not enough when
words beside them give them away, so the corpus is asked: over all rows, a term t of a text that holds an entity c
discloses ``PMI(c, t) / IC(c)`` of it, with ``PMI = log2(n(c,t) N / (n(c) n(t)))`` and ``IC = log2(N / n(c))``.
Terms that disclose everything are removed, terms above a threshold are generalised, in the texts that hold the entity.

Most entities occur once or twice, so c is the value and also what repeats of it: its family (mail domain, network, issuer, number
block), its kind, and all entities together.  Instead of a fixed support, the lower confidence bound of the PMI has to be above zero.

Positions come from the pieces between the matches, so no Python is needed: a match starts where the pieces and matches before it end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceassay.llm.store import free_name, settle

# The kinds in their order and what they look like.  The patterns are written so that Java finds the same
# leftmost, non-overlapping matches without recursion or repeated scans: loops are possessive where
# nothing can be given back, and a match may only start where a run of its characters does.
#   email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), parts at most 255
#   card   [0-9]([\x20-]?[0-9])+, 14 to 19 digits that pass Luhn
#   phone  \+[0-9][\x20().0-9-]+[0-9], 10 to 15 digits
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "phone": "+"}
_IP = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"

#: Kinds of the method's own spans, after the base kinds.
REMOVED, GENERALISED = "term-removed", "term-generalised"
#: Chance at most that any of an entity's terms stands in its texts by accident; the bound of the PMI follows from it.
ERROR = 0.05
#: Share of an entity's information at which a term is removed or generalised.
REMOVE, GENERALISE = 0.999, 0.95
#: Bytes up to which a table of terms is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 16 << 20
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Matches whose lengths are added up in one go; keeps the sums of many matches far from quadratic.
_BLOCK = 256


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total, k):
        d = F.substring(turned, k, F.lit(1)).cast("int")
        twice = 2 * d
        return total + F.when(k % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(_IP)
    if kind == "card":
        return _luhn(F.regexp_replace(value, "[ -]", ""))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda s, x: s + x)


def _with_spans(df: DataFrame, text: str, pattern: str | Column, name: str, pick, keep) -> DataFrame:
    """``df`` with an array of ``pick(k, value, start, gaps)`` for the matches ``k`` of ``pattern`` that ``keep(value)``."""
    t = F.col(text)
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    df = df.withColumn("__m", F.when(t.isNull() | pattern.isNull(), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(t, pattern, F.lit(0))))
    n = F.size("__m")
    df = df.withColumn("__g", F.when(n > 0, F.split(t, pattern, -1)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("__l", F.when(n > 0, F.transform(F.col("__m"), lambda m, k: F.length(m) + F.length(F.get("__g", k)))).otherwise(F.array().cast("array<int>")))
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int"))
    df = df.withColumn("__b", F.when(n > 0, F.transform(blocks, lambda b: _sum(F.slice("__l", b * _BLOCK + 1, F.lit(_BLOCK))))).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("__o", F.when(n > 0, F.transform(blocks, lambda b: _sum(F.slice("__b", F.lit(1), b)))).otherwise(F.array().cast("array<int>")))

    def start(k):
        block = F.floor(k / _BLOCK).cast("int")
        return F.get("__o", block) + _sum(F.slice("__l", block * _BLOCK + 1, k % _BLOCK)) + F.length(F.get("__g", k))
    places = F.filter(F.transform(F.col("__m"), lambda m, k: F.struct(k.alias("k"), m.alias("m"))), lambda x: keep(x["m"]))
    found = F.transform(places, lambda x: pick(x["k"], x["m"], start(x["k"])))
    return df.withColumn(name, found).drop("__m", "__g", "__l", "__b", "__o")


def _family(kind: str, value: Column) -> Column:
    """What repeats of an entity: mail domain, network of an address, issuer of a card, block of a phone number."""
    if kind == "email":
        return F.substring_index(value, "@", -1)
    if kind == "ip":
        return F.substring_index(value, ".", 3)
    return F.substring(value, 1, 6) if kind == "card" else F.substring(value, F.lit(1), F.length(value) - 4)


def base_spans(df: DataFrame, text: str = "text", name: str = "spans") -> DataFrame:
    """``df`` with the array of base spans: ``start, kind_no, end`` in code points, the hashes of the ``entity`` and its ``family``."""
    for no, kind in enumerate(KINDS):
        t = F.col(text)
        source = f"__t{no}"
        df = df.withColumn(source, F.when(t.contains(_NEEDS[kind]), t) if kind in _NEEDS else t)

        def pick(k, m, start, kind=kind, no=no):
            value = F.lower(m) if kind in ("email", "ip") else F.regexp_replace(m, "[^0-9]", "")
            return F.struct(start.alias("start"), F.lit(no).alias("kind_no"), (start + F.length(m)).alias("end"), F.xxhash64(F.lit(kind), value).alias("entity"),
                            F.xxhash64(F.lit(kind), F.lit("family"), _family(kind, value)).alias("family"))
        df = _with_spans(df, source, PATTERNS[kind], f"__s{no}", pick, lambda m, kind=kind: _valid(kind, m))
    found = F.concat(*[F.col(f"__s{no}") for no in range(len(KINDS))])
    return df.withColumn(name, F.array_sort(found)).drop(*[f"__{x}{no}" for x in "ts" for no in range(len(KINDS))])


def _terms(text: Column) -> Column:
    """Distinct lower-case words of a text outside its mail addresses; the other entities are digits, which are no terms."""
    words = F.split(F.lower(F.regexp_replace(text, PATTERNS["email"], " ")), _BETWEEN)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & w.rlike("[^0-9]")))


def _levels(spans: Column) -> Column:
    """Hashes of all that a text's entities are: values, families, kinds, and an entity at all."""
    each = F.transform(spans, lambda s: F.array(s["entity"], s["family"], F.xxhash64(F.lit("kind"), s["kind_no"]), F.xxhash64(F.lit("all"))))
    return F.array_distinct(F.flatten(each))


def _small(df: DataFrame, column: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast if the written table ``df`` is known to be small."""
    size = df.agg(F.sum(F.octet_length(F.col(column).cast("string")) + 16)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def _disclosing(docs: DataFrame, base: DataFrame, error: float, generalise: float) -> DataFrame | None:
    """``digest, term, share`` of the terms that give away an entity of the text; None if there are no entities.

    Counts are of rows; as evidence equal texts count once.  Of ``n`` texts with the term a share ``p`` holds the entity, where chance would
    give ``q`` (its rows or its bytes, whichever is more); by Chernoff's bound that has a chance of ``2 ** -(n KL(p, q))``.  Below ``error`` for
    all terms together the lower bound of the PMI is above zero.  One text is never enough, so what is in one text only is not asked about.
    """
    near = (base.where(F.size("spans") > 0).groupBy("digest")
            .agg(F.count("*").alias("m"), F.first("size").alias("size"), F.first(_levels(F.col("spans"))).alias("levels"), F.first("terms").alias("terms")))
    near = settle(near, "entity-texts")
    if near.isEmpty():
        return None
    rows, total = base.agg(F.count("*"), F.sum("size")).first()
    levels = near.select("digest", "m", "size", F.explode("levels").alias("level"))
    stats = (levels.groupBy("level").agg(F.sum("m").alias("n_c"), F.sum(F.col("m") * F.col("size")).alias("bytes"), F.count("*").alias("texts"))
             .where((F.col("texts") > 1) & (F.col("n_c") < rows) & (F.col("bytes") < total))
             .select("level", "n_c", F.greatest(F.col("n_c") / rows, F.col("bytes") / total).alias("q")))
    terms = near.select("digest", "m", F.explode("terms").alias("term"))
    asked = settle(terms.groupBy("term").agg(F.sum("m").alias("n_near"), F.count("*").alias("texts")).where("texts > 1").drop("texts"), "terms")
    bits = F.log2(F.lit(float(max(asked.count(), rows))) / error)
    # How many rows hold a term at all; only the asked terms are counted, and counted before they are moved.
    words = docs.where("text is not null").select(F.explode(F.array_distinct(F.split(F.lower("text"), _BETWEEN))).alias("term"))
    small, total_of = _small(asked, "term"), F.count("*").alias("n_t")
    counts = words.join(small, "term").groupBy("term", "n_near").agg(total_of) if small is not asked else words.groupBy("term").agg(total_of).join(asked, "term")
    # No entity has more than log2(rows) of information, nor more of the term's rows than all entities together: spares most words.
    rare = counts.where(F.col("n_near") / F.col("n_t") * (1 + 1e-9) >= float(rows) ** (generalise - 1)).select("term", "n_t")
    rare = _small(settle(rare, "rare-terms"), "term")
    held = settle(terms.join(rare, "term"), "held-terms").join(levels.join(stats, "level").select("digest", "level", "n_c", "q"), "digest")
    p, q = F.least(F.lit(1.0), F.col("n_ct") / F.col("n_t")), F.col("q")
    apart = p * F.log2(p / q) + F.when(p < 1, (1 - p) * F.log2((1 - p) / (1 - q))).otherwise(0.0)
    # An entity can only be in a part of the texts that hold the term.
    share = 1 + F.log2(p) / F.log2(F.lit(float(rows)) / F.col("n_c"))
    found = (held.groupBy("level", "term", "n_c", "q", "n_t").agg(F.sum("m").alias("n_ct"), F.count("*").alias("texts")).where("texts > 1")
             .withColumn("share", share).where((F.col("share") >= generalise) & (p > q) & (F.col("texts") / p * apart >= bits)))
    found = _small(settle(found.select("level", "term", "share"), "disclosing"), "term")
    return held.join(found, ["level", "term"]).groupBy("digest", "term").agg(F.max("share").alias("share"))


def _term_spans(docs: DataFrame, terms: DataFrame, remove: float) -> DataFrame:
    """``digest, more``: the spans of disclosing terms (``digest, term, share``) in their texts."""
    wanted = terms.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("term", "share"))).alias("wanted"))  # bounded by a text's terms
    wanted = _small(settle(wanted, "wanted"), "wanted")
    either = F.array_join(F.transform(F.col("wanted.term"), lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))), "|")
    # Whole words in any case, as lower() has folded them.
    edge = _WORD[:-1].replace("[^", "").replace("]", "")
    pattern = F.concat(F.lit(r"(?iu)(?<![^" + edge + r"])(?<![A-Z])(?:"), either, F.lit(r")(?![^" + edge + r"])(?![A-Z])"))
    found = docs.select(F.md5("text").alias("digest"), "text").join(wanted, "digest").withColumn("__p", pattern)

    def pick(k, m, start):
        share = F.aggregate("wanted", F.lit(0.0), lambda s, x: F.greatest(s, F.when(x["term"] == F.lower(m), x["share"]).otherwise(0.0)))
        return F.struct(start.alias("start"), F.when(share >= remove, len(KINDS)).otherwise(len(KINDS) + 1).alias("kind_no"), (start + F.length(m)).alias("end"))
    found = _with_spans(found, "text", F.col("__p"), "more", pick, lambda m: F.lit(True))
    return found.groupBy("digest").agg(F.first("more").alias("more"))


def kind_name(no: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in (*KINDS, REMOVED, GENERALISED)]), no + 1)


def find(docs: DataFrame, error: float = ERROR, remove: float = REMOVE, generalise: float = GENERALISE) -> tuple[DataFrame, str]:
    """All columns of ``docs`` but the text, the text's ``digest`` and the spans (``start, kind_no, end``, sorted); and the spans' name.

    Struct ``personal`` (or the next free name) holds ``digest``, ``base`` and ``more``.  Null texts count as empty and have
    no spans.  Equal texts have equal spans and count once as evidence.  Terms inside a base span
    are no spans of their own.  An empty table gives no rows.
    """
    keep = [c for c in docs.columns if c != "text"]
    name = free_name(docs, "personal")
    text = F.coalesce("text", F.lit(""))
    doc = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(1).alias("none"))
    base = base_spans(docs.select(doc.alias("doc"), text.alias("text"))).withColumn("digest", F.md5("text"))
    base = base.withColumn("terms", F.when(F.size("spans") > 0, _terms(F.col("text")))).withColumn("size", F.octet_length("text")).drop("text")
    base = settle(base, "spans")
    texts = docs.select("text")
    terms = _disclosing(texts, base, error, generalise)
    slim = F.transform("spans", lambda s: F.struct(s["start"], s["kind_no"], s["end"]))
    if terms is None:
        out = base.withColumn("more", F.array().cast("array<struct<start:int,kind_no:int,end:int>>"))
    else:
        more = _small(settle(_term_spans(texts, terms, remove), "term-spans"), "more")
        free = F.filter("more", lambda m: ~F.exists("spans", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
        out = base.join(more, "digest", "left").withColumn("more", F.coalesce(free, F.array()))
    return out.select(*[F.col("doc")[c].alias(c) for c in keep],
                      F.struct("digest", slim.alias("base"), F.col("more").alias("more")).alias(name)), name


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the spans blanked in the text: ``[EMAIL]`` and so on, ``[TERM]`` for a generalised term, nothing for a removed one.

    Of overlapping spans the first decides how they are blanked, and all of them go.
    """
    found, name = find(docs, **options)
    spans = F.array_sort(F.concat(F.col(name)["base"], F.col(name)["more"]))
    by_text = found.select(F.col(name)["digest"].alias("__digest"), spans.alias("__spans")).where("size(__spans) > 0").dropDuplicates(["__digest"])
    by_text = _small(settle(by_text, "blanked"), "__spans")

    def step(a, s):
        late = s["start"] >= a["at"]
        label = F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit(""), F.lit("[TERM]")), s["kind_no"] + 1)
        piece = F.concat(F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), label)
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(late, F.concat(a["out"], F.array(piece))).otherwise(a["out"]).alias("out"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate("__spans", begin, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    blanked = docs.withColumn("__digest", F.md5(F.coalesce("text", F.lit("")))).join(by_text, "__digest", "left")
    return blanked.withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(done)).select(*[f"`{c}`" for c in docs.columns])


def op8(spark, sf_dir: str) -> DataFrame:
    found, name = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = found.select("doc_id", F.col(name)["base"].alias("base"), F.col(name)["more"].alias("more"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind_name(s["kind_no"]), s["start"], s["end"])), ",")

    def count(no: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind_no"] == no)).cast("long")
    counts = [count(no).alias(f"n_{kind}") for no, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                        listed(F.array_sort(F.concat("base", "more"))).alias("spans"))
