"""Operator 2: personal data by candidate gradient boosting. DataFrame functions only."""

from __future__ import annotations

import json
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import asset, table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, written so that they take time in proportion to the text: possessive where nothing can be given back, and with
#: a look behind where a match that starts later in a run can't succeed if the run's start fails (a match may also start where
#: the one before ended, \G).
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators of further candidates: forms that people write and the base patterns miss. A bare dot of a mail domain has no space
#: beside it, so that no candidate reaches over the end of a sentence.
MORE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}+(?: ?(?:\[(?i:at)\]|\((?i:at)\)|\{(?i:at)\}) ?|\x20(?:at|AT)\x20)[A-Za-z0-9-]{1,63}+(?:(?: ?(?:\[(?i:dot)\]|\((?i:dot)\)|\{(?i:dot)\}) ?|\x20(?:dot|DOT)\x20|\.)[A-Za-z0-9-]{2,24}+){1,4}+(?![A-Za-z0-9@])",
    "ip": r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\[dot\])[0-9]{1,3}+){3})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9._/])[0-9]{4}(?:[._/][0-9]{4}){2}[._/][0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9.+/-])\(?[0-9]{2,4}+\)?(?:[\x20./-]\x20?[0-9]{2,4}+){2,4}+(?![0-9])",
}
#: Characters before a candidate that count as its context, and what is looked for there.
BEFORE = 32
CONTEXT = {
    "says_phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|dial|ring|whatsapp|sms)\W",
    "says_mail": r"(?i)(?:mail|contact|write|reach|address)\W",
    "says_card": r"(?i)(?:card|visa|credit|debit|payment|mastercard)\W",
    "says_host": r"(?i)(?:\bip\b|host|server|from|addr|login)\W?",
    "says_other": r"(?i)(?:order|invoice|version|isbn|ref|ticket|page|chapter|total|code|item|no\.|nr\.|part|score|model|section|look|meet|arrive|stay)\W",
}
#: Ends of mail domains that count as known (fixed values), and what in a candidate speaks for or against it.
TLDS = "com org net edu gov mil int info biz io dev app ai co me eu de fr es it nl be ch at uk ie us ca mx br ar cl pt pl se no fi dk cz jp cn in au nz za ru".split()
WITHIN = {
    "known_tld": rf"(?i)(?:\.|dot[\])}}]? ?)(?:{'|'.join(TLDS)})$",
    "at_in_brackets": r"(?i)[\[({]at[\])}]",
    "dot_as_word": r"(?i)(?:[\[({]dot[\])}]|\x20dot\x20)",
    "like_a_date": r"(?:^|[^0-9])(?:(?:19|20)[0-9]{2}[./-][01]?[0-9][./-][0-3]?[0-9]|[0-3]?[0-9][./-][01]?[0-9][./-](?:19|20)[0-9]{2})(?:[^0-9]|$)",
    "like_years": r"(?:^|[^0-9])(?:19|20)[0-9]{2}\x20(?:19|20)?[0-9]{2}(?:[^0-9]|$)",
}
FEATURES = ("kind_no", "digits", "length", "separators", "brackets", "luhn", "groups", "letters", *WITHIN, *CONTEXT)


def once(value: Column, f) -> Column:
    """f(value), where value is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def folded(items: Column, zero: Column, step, kind: str) -> Column:
    return once(items, lambda own: _folded(own, zero, step, kind))


def _folded(items: Column, zero: Column, step, kind: str) -> Column:
    """F.aggregate() of a struct(at, out), in which a step gives the next at and the elements (an array of kind) that it adds to out.

    Elements are gathered in blocks of about the square root of their number: an array is copied whenever it grows, so one array alone
    would take time in the square of its length.
    """
    none = F.array().cast(f"array<{kind}>")
    block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int"))

    def inner(acc, x):
        at, new = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], new).alias("out"))

    def outer(acc, i):
        part = F.aggregate(F.slice(items, i * block + 1, block), F.struct(acc["at"].alias("at"), none.alias("out")), inner)
        return once(part, lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], p["out"]).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int"))
    whole = F.aggregate(blocks, F.struct(zero.alias("at"), none.alias("out")), outer)
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, whole)


def pieces(text: Column, pattern: str) -> Column:
    """(gap, hit) of the leftmost non-overlapping matches: what stands before each, and the match.

    The text is split by the pattern and its matches taken, by the same expression engine: pieces and matches alternate.
    """

    def pairs(hits):
        both = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return F.when(F.size(hits) > 0, both).otherwise(F.array().cast("array<struct<gap:string,hit:string>>"))

    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), pairs)


def found(text: Column, pattern: str) -> Column:
    """(start, end, hit, before) of the matches, in code points; before is the end of what stands between this match and the one before it."""

    def step(at, x):
        start = at + F.length(x["gap"])
        end = start + F.length(x["hit"])
        before = F.right(x["gap"], F.lit(BEFORE))
        return end, F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), before.alias("before")))

    kind = "struct<start:int,end:int,hit:string,before:string>"
    return F.coalesce(folded(pieces(text, pattern), F.lit(0), step, kind)["out"], F.array().cast(f"array<{kind}>"))


def masked(text: Column, kind: str) -> Column:
    """text with good base matches of a kind written over, sign by sign, by a sign that no pattern takes."""
    over = lambda h: F.when(passes(kind, h), F.repeat(F.lit("\x01"), F.length(h))).otherwise(h)

    def written(hits):
        """Pieces and matches in turn; there is one piece more."""
        whole = F.array_join(F.zip_with(F.split(text, BASE[kind], -1), hits, lambda g, h: F.concat(g, F.coalesce(over(h), F.lit("")))), "")
        return F.when(F.size(hits) > 0, whole).otherwise(text)

    return once(F.regexp_extract_all(text, F.lit(BASE[kind]), F.lit(0)), written)


def digits_of(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the digits, 12 to 19 of them, pass the check sum."""
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.when((n >= 12) & (n <= 19), F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0).otherwise(F.lit(False))


def passes(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return hit.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return luhn(digits_of(hit))
    if kind == "phone":
        n = F.length(digits_of(hit))
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """(start, kind_no, end) of the base matches, by start, then kind. Failing matches go without another try."""

    def one(i: int, kind: str) -> Column:
        good = F.filter(found(text, BASE[kind]), lambda m: passes(kind, m["hit"]))
        return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind_no"), m["end"].alias("end")))

    return F.array_sort(F.concat(*[one(i, k) for i, k in enumerate(KINDS)]))


def features(kind_no: int, m: Column) -> Column:
    """Format and context of a candidate, as a struct of doubles."""
    hit, digits = m["hit"], digits_of(m["hit"])
    values = {
        "kind_no": F.lit(kind_no), "digits": F.length(digits), "length": F.length(hit),
        "separators": F.length(F.regexp_replace(hit, r"[^\x20./:_-]", "")), "brackets": F.length(F.regexp_replace(hit, r"[^()\[\]]", "")),
        "luhn": luhn(digits).cast("int"), "groups": F.size(F.split(hit, "[^0-9]+")), "letters": F.length(F.regexp_replace(hit, "[^A-Za-z]", "")),
    }
    values |= {k: hit.rlike(p).cast("int") for k, p in WITHIN.items()}
    values |= {k: m["before"].rlike(p).cast("int") for k, p in CONTEXT.items()}
    return F.struct(*[values[k].cast("double").alias(k) for k in FEATURES])


def candidates(text: Column) -> Column:
    """(start, kind_no, end, x) of what the generators propose where no base span is; proposals of different generators may overlap."""

    def free(kinds, own):
        return once(masked(own, kinds[0]), lambda t: free(kinds[1:], t)) if kinds else F.concat(*[one(i, k, own) for i, k in enumerate(KINDS)])

    def one(i: int, kind: str, own: Column) -> Column:
        return F.transform(found(own, MORE[kind]), lambda m: F.struct(m["start"].alias("start"), F.lit(i).alias("kind_no"), m["end"].alias("end"), features(i, m).alias("x")))

    return free(KINDS, text)


@lru_cache
def model() -> dict:
    """Trees, prior and thresholds by kind that pii_train.py has made: a tree is [feature, cut, left, right], a leaf a number."""
    with open(asset("pii_model.json")) as f:
        return json.load(f)


def margin(x: Column) -> Column:
    """Log odds by the boosted trees."""

    def tree(t) -> Column:
        return F.lit(float(t)) if isinstance(t, (int, float)) else F.when(x[t[0]] <= t[1], tree(t[2])).otherwise(tree(t[3]))

    return reduce(lambda a, b: a + b, [tree(t) for t in model()["trees"]], F.lit(float(model()["prior"])))


def added_spans(text: Column) -> Column:
    """(start, kind_no, end) of candidates at or above their kind's calibrated threshold. Of a candidate and one that it overlaps and that starts later
    the one stays that is further above its threshold (equal: the first)."""
    limits = F.array(*[F.lit(float(model()["thresholds"][k])) for k in KINDS])
    scored = F.transform(candidates(text), lambda c: F.struct(c["start"].alias("start"), c["kind_no"].alias("kind_no"), c["end"].alias("end"), (margin(c["x"]) - F.get(limits, c["kind_no"])).alias("over")))
    good = F.array_sort(F.filter(scored, lambda c: c["over"] >= 0))
    kind = "struct<start:int,kind_no:int,end:int,over:double>"

    def step(held, c):
        """held is the last candidate that has not been overlapped by a better one yet; it is passed on when the next lies beyond it."""
        apart = held.isNull() | (held["end"] <= c["start"])
        done = F.when(held.isNull() | ~apart, F.array().cast(f"array<{kind}>")).otherwise(F.array(held))
        return F.when(apart | (c["over"] > held["over"]), c).otherwise(held), done

    none = F.array().cast(f"array<{kind}>")
    kept = once(folded(good, F.lit(None).cast(kind), step, kind), lambda swept: F.when(swept.isNotNull(), F.concat(swept["out"], F.array(swept["at"]))).otherwise(none))
    return F.transform(kept, lambda c: F.struct(c["start"].alias("start"), c["kind_no"].alias("kind_no"), c["end"].alias("end")))


def with_spans(docs: DataFrame) -> DataFrame:
    """docs with a column pii = struct(base, spans), arrays of (start, kind_no, end) by start, then kind, in code points, ends
    exclusive. A null text has none. Other columns pass unchanged, whatever their names."""
    own = docs.select(F.struct("*").alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("base", base_spans(F.col("text")))
    own = own.withColumn("spans", F.array_sort(F.concat("base", added_spans(F.col("text")))))
    return own.select("doc", "text", "base", "spans")


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in square brackets; overlapping spans become one, named after the first.

    A null text stays null. n_chars, if there is one, follows the text.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size("spans").cast("double"))).cast("int"))

    # Blocks of spans cut their own stretch out of the text, so that a text with very many spans isn't walked from its start for each.
    def outer(acc, i):
        mine = F.slice("spans", i * block + 1, block)
        end = F.greatest(acc["at"], F.array_max(F.transform(mine, lambda s: s["end"])))
        stretch = F.struct(acc["at"].alias("from"), F.substring(F.col("text"), acc["at"] + 1, end - acc["at"]).alias("text"))

        def inner(a, s):
            new = F.concat(a["out"], F.substring(a["stretch"]["text"], a["at"] - a["stretch"]["from"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind_no"] + 1))
            inside = s["start"] < a["at"]
            at = F.when(inside, F.greatest(a["at"], s["end"])).otherwise(s["end"])
            return F.struct(at.alias("at"), F.when(inside, a["out"]).otherwise(new).alias("out"), a["stretch"].alias("stretch"))

        part = F.aggregate(mine, F.struct(acc["at"].alias("at"), F.lit("").alias("out"), stretch.alias("stretch")), inner)
        return once(part, lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], F.array(p["out"])).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor((F.size("spans") - 1) / block).cast("int"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    whole = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text")))
    found_ = with_spans(docs)
    text = F.when(F.size("spans") == 0, F.col("doc.text")).otherwise(F.aggregate(blocks, zero, outer, whole))
    made = found_.select("doc", text.alias("new_text"))
    columns = [F.col("new_text").alias(c) if c == "text" else F.length("new_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("doc")[c].alias(c) for c in docs.columns]
    return made.select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda i: F.size(F.filter("base", lambda s: s["kind_no"] == i)).cast("long")
    return docs.select(
        "doc.doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
