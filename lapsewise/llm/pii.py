"""Personal data by patterns, checksums and context, with DataFrame functions only.

Regular expressions propose spans; parts of an address, the Luhn sum and the mod-97 sum confirm them; words nearby move
the score. Spans are in code points, end exclusive. The base kinds (email, ip, card, phone) stand whatever their score;
bank account numbers are added when their score reaches ACCEPT.

The patterns loop over single characters only, so that very long texts neither exhaust the stack nor backtrack over the
same characters again. A pattern's places are the running sum of the lengths of what lies between and of what matched.

Nulls: a null text is an empty one (redact leaves it null); a null doc_id stays a row of its own. Repeated rows give
repeated rows. Of spans of different kinds with one start, the kind listed first comes first. Extra columns are ignored
by the digest and kept by redact, whatever their names. Empty tables give empty results. Places are found by sums over
chunks, so that the work on a text with very many matches grows with their number times its root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lapsewise.llm.shared import let, read_table, running_sums, scan

#: kind: (pattern, a text without this never matches, score, context words). Order is the order of kinds.
KINDS = {
    # a local part starts where no local character stands before it, or where the last match ended; the domain ends
    # before what is neither a label character nor a dot with a label character after it, and holds such a dot
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++\.[A-Za-z0-9-])[A-Za-z0-9.-]*?(?![A-Za-z0-9-]|\.[A-Za-z0-9-])", "@", 0.7, "mail|write|contact|reach"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.5, r"\bip\b|host|server|address|login"),
    "card": (r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?(?![0-9]|[\x20-][0-9])", None, 0.4, "card|visa|master|amex|pay|credit"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.5, "phone|tel|call|mobile|fax|dial"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None, 0.4, "iban|account|bank|transfer|bic"),
}
BASE = ("email", "ip", "card", "phone")
CHECKSUM, CONTEXT, ACCEPT = 0.4, 0.1, 0.75
#: Code points before and after a span in which context words count.
BEFORE, AFTER = 40, 20


def luhn(digits: Column) -> Column:
    """True if the digit string passes the Luhn sum."""
    turned = F.reverse(digits)
    doubled = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(turned, i, F.lit(1)).try_cast("int") * (2 - i % 2))
    return F.aggregate(doubled, F.lit(0), lambda acc, x: acc + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def mod97(account: Column) -> Column:
    """True if the account number, its first four characters moved to the end, is 1 modulo 97."""
    moved = F.split(F.concat(F.substring(account, 5, 99), F.substring(account, 1, 4)), "")
    moved = F.array_remove(moved, "")
    return F.aggregate(moved, F.lit(0), lambda acc, c: F.when(c >= "A", (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97)) == 1


def confirmed(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        small = lambda p: F.coalesce(F.nullif(F.ltrim(p, F.lit("0")), F.lit("")), F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda p: (F.length(small(p)) <= 3) & (small(p).try_cast("int") <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        plain = F.replace(value, F.lit(" "), F.lit(""))
        return F.when(F.length(plain).between(15, 34), mod97(plain)).otherwise(False)
    return F.lit(True)


def shortened(span: Column) -> Column:
    """An account number's proposal without the words behind it: of its beginnings that end with a group, the longest that is confirmed.

    A number may be followed by a word in capitals, which the pattern cannot tell from a group of the number.
    """
    groups = F.split(span["value"], " ", -1)
    beginnings = F.transform(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(groups, F.lit(1), k), " "))
    longest = F.get(F.filter(beginnings, lambda v: confirmed("iban", v)), F.lit(0))

    def cut(value: Column) -> Column:
        value = F.coalesce(value, span["value"])
        rest = F.substring(span["value"], F.length(value) + 1, F.length(span["value"]))
        return F.struct(span["start"].alias("start"), (span["start"] + F.length(value)).alias("stop"), value.alias("value"), span["before"].alias("before"), F.left(F.concat(rest, span["after"]), F.lit(AFTER)).alias("after"))

    return let(longest, cut)


def proposals(text: Column, hits: Column, pattern: str) -> Column:
    """start, stop, value and surroundings of every match, from what lies between the matches."""

    def placed(between: Column) -> Column:
        stops = running_sums(F.transform(hits, lambda h, i: (F.length(F.get(between, i)) + F.length(h)).cast("long")))

        def one(stop: Column, i: Column) -> Column:
            value = F.get(hits, i)
            before, after = F.right(F.get(between, i), F.lit(BEFORE)), F.left(F.get(between, i + 1), F.lit(AFTER))
            return F.struct((stop - F.length(value)).alias("start"), stop.alias("stop"), value.alias("value"), before.alias("before"), after.alias("after"))

        return F.transform(stops, one)

    item = "array<struct<start:long,stop:long,value:string,before:string,after:string>>"
    return F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), placed)).otherwise(F.array().cast(item))


def spans_of(text: Column, kind: str, rank: int, hits: Column) -> Column:
    pattern, _, score, words = KINDS[kind]
    found = proposals(text, hits, pattern)
    if kind == "iban":
        found = F.transform(found, shortened)
    found = F.filter(found, lambda s: confirmed(kind, s["value"]))

    def scored(s: Column) -> Column:
        near = F.lower(F.concat(s["before"], F.lit(" "), s["after"])).rlike(words)
        points = F.lit(score + (CHECKSUM if kind in ("card", "iban") else 0.0)) + F.when(near, CONTEXT).otherwise(0.0)
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), s["value"].alias("value"), F.round(points, 3).alias("score"))

    found = F.transform(found, scored)
    return found if kind in BASE else F.filter(found, lambda s: s["score"] >= ACCEPT)


def rows_with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """row (all columns of docs, as a struct), whole (its text), pii: array of (start, rank, stop, kind, value, score), by start, then kind."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    hits = {}
    for kind, (pattern, needs, _, _) in KINDS.items():
        all_ = F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))
        hits[kind] = F.when(F.contains(whole, F.lit(needs)), all_).otherwise(F.array().cast("array<string>")) if needs else all_
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), whole.alias("whole"), F.struct(*[h.alias(k) for k, h in hits.items()]).alias("hits"))
    found = F.array_sort(F.concat(*[spans_of(F.col("whole"), kind, rank, F.col(f"hits.{kind}")) for rank, kind in enumerate(KINDS)]))
    return rows.select("row", "whole", found.alias("pii"))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus pii, in place of a column pii that docs may have."""
    return rows_with_spans(docs, text).select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "pii"], "pii")


def redacted(text: Column, pii: Column) -> Column:
    """text with every span replaced by its kind in brackets; of overlapping spans the first names the run.

    The text is cut at every root-of-the-number-of-runs-th run, and inside these cuts at the others, so that the work
    grows with the text, times that root.
    """

    def with_reach(reach: Column) -> Column:
        # reach: the farthest stop so far. A span that starts at or beyond the reach before it begins a run.
        firsts = F.filter(F.transform(pii, lambda s, i: F.when((i == 0) | (s["start"] >= F.get(reach, i - 1)), i)), lambda i: i.isNotNull())
        to_runs = lambda f: F.transform(f, lambda i, k: F.struct(F.get(pii, i)["start"].alias("start"), F.get(reach, F.coalesce(F.get(f, k + 1), F.size(pii)) - 1).alias("stop"), F.get(pii, i)["kind"].alias("kind")))
        return let(firsts, lambda f: let(to_runs(f), cut))

    def cut(runs: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(runs))).cast("int")
        end = F.length(text).cast("long")

        def chunk(c: Column) -> Column:
            own = F.slice(runs, c * size + 1, size)
            left = F.coalesce(F.get(runs, c * size - 1)["stop"], F.lit(0).cast("long"))
            right = F.when((c + 1) * size < F.size(runs), F.get(own, F.size(own) - 1)["stop"]).otherwise(end)
            part = F.substring(text, (left + 1).cast("int"), (right - left).cast("int"))

            def piece(x: Column) -> Column:
                def one(r: Column, i: Column) -> Column:
                    from_ = F.coalesce(F.get(own, i - 1)["stop"], left) - left
                    return F.concat(F.substring(x, (from_ + 1).cast("int"), (r["start"] - left - from_).cast("int")), F.lit("["), F.upper(r["kind"]), F.lit("]"))

                rest = F.get(own, F.size(own) - 1)["stop"] - left
                return F.concat(F.array_join(F.transform(own, one), ""), F.substring(x, (rest + 1).cast("int"), F.lit(2**31 - 1)))

            return let(part, piece)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(runs) - 1) / size).cast("int")), chunk), "")

    stops = F.transform(pii, lambda s: s["stop"])
    reach = let(stops, lambda x: scan(x, F.lit(0).cast("long"), lambda p, q: F.greatest(p, q)))
    return F.when(F.size(pii) > 0, let(reach, with_reach)).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans of text replaced; n_chars, if there, follows. All other columns stay as they are."""
    rows = rows_with_spans(docs)
    text = F.when(F.col("row.text").isNotNull(), redacted(F.col("whole"), F.col("pii")))
    rows = rows.select("row", text.alias("new"))
    given = {"text": F.col("new")} | ({"n_chars": F.length("new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[given.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    of = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(kind).alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
