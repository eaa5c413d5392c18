"""Personal data by weak supervision, in DataFrame functions alone.

Fixed patterns with checks find the base kinds (email, ip, card, phone); those
spans always stand.  Looser candidates (strings that may be secrets, grouped
numbers, account numbers, names after a title, street addresses) are voted on by
labelers of three sorts: regular expressions for known shapes and a check sum, a
gazetteer of words that speak for or against a kind, and the context right
before the candidate.  Expectation-maximisation over how often each pattern of
votes occurs estimates how reliable each labeler is, and its posteriors train a
logistic classifier that decides which candidates become spans.  Besides votes
it sees what no labeler votes on: length, variety of characters, quotes.

Texts are only touched by built-in functions, and only once: what is found in
them is a table that both the fits and the result read.  What reaches the driver
is one row for each pattern of votes and shape, at most ``PATTERNS`` rows
whatever the data's size; both fits run on those counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, fresh, stored

# Possessive repeats and look-behinds only spare the engine retries; the leftmost matches are those of the plain patterns.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|(?<=[A-Za-z0-9-])(?=[._%+]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# The longest runs of single digits and separators that have 16 to 19 digits; no shorter or longer run can pass.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+"
NUMBER = r"(?<![0-9+])\(?[0-9]{2,4}+\)?[\x20.-][0-9]{2,4}+[\x20.-][0-9]{3,4}+(?![0-9])"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Monsieur", "Madame")
NAME = rf"(?<![\p{{L}}])(?:{'|'.join(TITLES)})\.?\x20\p{{Lu}}\p{{L}}+(?:\x20\p{{Lu}}\p{{L}}+)?"
STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Boulevard", "Lane", "Drive", "Court", "Square")
ADDRESS = rf"(?<![0-9\p{{L}}.,])[0-9]{{1,5}}+\x20(?:\p{{Lu}}\p{{L}}+\x20){{1,3}}(?:{'|'.join(STREETS)})(?![\p{{L}}])"
BASE = ("email", "ip", "card", "phone")
ADDED = {"secret": SECRET, "number": NUMBER, "account": ACCOUNT, "name": NAME, "address": ADDRESS}
#: Words near a candidate that speak for (1) or against (0) each kind.
GAZETTEER = {
    "secret": {1: "password passwd pwd secret token key api_key apikey access_key auth bearer credential", 0: "commit sha sha1 sha256 md5 checksum digest hash revision uuid isbn"},
    "number": {1: "phone tel telephone mobile cell fax ssn call", 0: "version page pages isbn figure table chapter year date lines total"},
    "account": {1: "iban account konto cuenta compte bank", 0: "part model version serial isbn code"},
    "name": {1: "contact name signed patient customer client dear from", 0: "play film book character street the"},
    "address": {1: "address lives live residence home ship mail at", 0: "about over than of by"},
}
LABELERS = ("shape", "gazetteer", "context", "mixed")
SHAPES = ("bucket", "variety", "quoted")
PATTERNS = len(ADDED) * 3 ** len(LABELERS) * 4 * 3 * 2
SPAN = "array<struct<s:int,e:int,m:string,before:string>>"
#: Elements that a fold copies at most when it adds one.
PART = 64


class Grown:
    """A growing array within a fold's state: full parts of ``PART`` elements, and the part that grows, so that n elements cost n * PART copies."""

    FIELDS = ("part", "parts")

    def __init__(self, kind: str):
        self.kind = kind

    def start(self) -> list[Column]:
        return [F.array().cast(f"array<{self.kind}>").alias("part"), F.array().cast(f"array<array<{self.kind}>>").alias("parts")]

    def add(self, seen: Column, item: Column, there: Column) -> list[Column]:
        """The fields after ``item``, if it is ``there``."""
        full = F.size(seen["part"]) >= PART
        part = F.when(full, F.array(item)).otherwise(F.concat(seen["part"], F.array(item)))
        return [F.when(there, part).otherwise(seen["part"]).alias("part"), F.when(there & full, F.concat(seen["parts"], F.array(seen["part"]))).otherwise(seen["parts"]).alias("parts")]

    @staticmethod
    def all(seen: Column) -> Column:
        return F.flatten(F.concat(seen["parts"], F.array(seen["part"])))


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their places in code points and what stands right before them.

    One expression takes what lies between matches and the match in turns, and
    ends with an empty match at the end of the text, so that no part is
    searched twice.
    """
    turns = F.lit(f"(?s)(.*?)({pattern}|\\z)")
    pairs = F.arrays_zip(F.regexp_extract_all(text, turns, F.lit(1)).alias("g"), F.regexp_extract_all(text, turns, F.lit(2)).alias("h"))
    grown = Grown("struct<s:int,e:int,m:string,before:string>")

    def step(seen: Column, x: Column) -> Column:
        start = seen["p"] + F.length(x["g"])
        end = start + F.length(x["h"])
        span = F.struct(start.alias("s"), end.alias("e"), x["h"].alias("m"), F.right(x["g"], F.lit(40)).alias("before"))
        return F.struct(end.alias("p"), *grown.add(seen, span, F.length(x["h"]) > 0))

    return F.aggregate(pairs, F.struct(F.lit(0).alias("p"), *grown.start()), step, grown.all)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right Luhn check digit."""
    from_right = F.reverse(F.split(number, ""))
    doubled = F.transform(from_right, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _byte(part: Column) -> Column:
    rest = F.regexp_replace(part, "^0+", "")
    return (F.length(rest) <= 3) & (F.when(rest == "", 0).otherwise(F.substring(rest, 1, 4).cast("int")) <= 255)


def base_spans(docs: DataFrame, text: str, names: dict[str, str]) -> DataFrame:
    """Add a column of checked spans for each base kind, and "digit": whether the text has any."""
    docs = docs.withColumn(names["digit"], F.col(text).rlike("[0-9]"))
    t, digit, none = F.col(text), F.col(names["digit"]), F.array().cast(SPAN)
    size = lambda x: F.length(digits(x["m"]))
    return docs.withColumns({
        names["email"]: F.when(t.contains("@"), located(t, EMAIL)).otherwise(none),
        names["ip"]: F.when(digit & t.rlike(r"[0-9]\.[0-9]"), F.filter(located(t, IP), lambda x: F.forall(F.split(x["m"], r"\."), _byte))).otherwise(none),
        names["card"]: F.when(digit, F.filter(located(t, CARD), lambda x: luhn(digits(x["m"])))).otherwise(none),
        names["phone"]: F.when(digit & t.contains("+"), F.filter(located(t, PHONE), lambda x: size(x).between(8, 15))).otherwise(none),
    })


def free_of(spans: Column, taken: Column) -> Column:
    """The spans that touch none of ``taken``, by one pass over both in order.

    ``spans`` don't overlap each other, so only the last one can touch the next
    of ``taken``; it waits until that is known.
    """
    kind = "struct<s:int,e:int,m:string,before:string>"
    grown = Grown(kind)
    mark = lambda taken: lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), x["before"].alias("before"), F.lit(taken).alias("taken"))
    both = F.array_sort(F.concat(F.transform(spans, mark(0)), F.transform(taken, mark(1))))

    def step(seen: Column, x: Column) -> Column:
        waits, is_taken = seen["waits"], x["taken"] == 1
        own = F.struct(*[x[f].alias(f) for f in ("s", "e", "m", "before")])
        leaves = waits.isNotNull() & ~(is_taken & (waits["e"] > x["s"]))
        after = F.when(~is_taken & (x["s"] >= seen["end"]), own)
        return F.struct(F.when(is_taken, F.greatest(seen["end"], x["e"])).otherwise(seen["end"]).alias("end"), after.alias("waits"), *grown.add(seen, waits, leaves))

    def last(seen: Column) -> Column:
        return F.concat(grown.all(seen), F.when(seen["waits"].isNotNull(), F.array(seen["waits"])).otherwise(F.array().cast(f"array<{kind}>")))

    start = F.struct(F.lit(0).alias("end"), F.lit(None).cast(kind).alias("waits"), *grown.start())
    return F.when((F.size(spans) > 0) & (F.size(taken) > 0), F.aggregate(both, start, step, last)).otherwise(spans)


def vote(yes: Column, no: Column) -> Column:
    """1 private, 0 not, -1 no opinion; both at once are no opinion."""
    return F.when(yes & ~no, 1).when(no & ~yes, 0).otherwise(-1)


def valid_account(m: Column) -> Column:
    """Whether the number has right check digits modulo 97, letters counting as 10 to 35."""
    code = F.regexp_replace(m, "\\x20", "")
    moved = F.split(F.concat(F.substring(code, 5, 99), F.substring(code, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(moved, F.lit(0), lambda rest, c: (rest * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97) == 1


def labelled(kind: str, x: Column) -> Column:
    """The votes of all labelers on a candidate, and what the classifier sees beside them."""
    m, before = x["m"], x["before"]
    share = F.length(digits(m)) / F.length(m)
    if kind == "secret":
        shape = vote(m.rlike(r"^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{16,64}|[0-9A-F]{32,64})$"), m.rlike(r"^(?:[A-Za-z]?[a-z]*[0-9]{1,4}|[A-Z]{2}[0-9]{2}[A-Z0-9]*)$"))
        context = vote(before.rlike(r"[=:]\s*[\"']?$"), before.rlike(r"[/@#&?]$"))
    elif kind == "number":
        shape = vote(m.rlike(r"^(?:\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})$"), m.rlike(r"^[0-9]{4}[.-][0-9]{2}[.-]"))
        context = vote(before.rlike(r"[:#]\s*$"), before.rlike(r"[0-9a-z,.]\s*$"))
    elif kind == "account":
        shape = vote(valid_account(m), ~valid_account(m))
        context = vote(before.rlike(r"[:#]\s*$"), before.rlike(r"[-/_]$"))
    elif kind == "name":
        shape = vote(m.rlike(r"\x20\p{Lu}\p{L}+\x20\p{Lu}\p{L}+$"), m.rlike(r"\x20\p{Lu}+$"))
        context = vote(before.rlike(r"(?:[:,]\s*|\n)$"), before.rlike(r"[\"“«]$"))
    else:
        shape = vote(m.rlike(r"^[0-9]{1,4}\x20"), m.rlike(r"^(?:19|20)[0-9]{2}\x20"))
        context = vote(before.rlike(r"(?:[:,]\s*|\n)$"), before.rlike(r"[$€£%]\s*$"))
    mixed = vote(share.between(0.1, 0.9), share < 0.05)
    # The last words before the candidate.
    near = F.slice(F.concat(F.array(F.lit(""), F.lit(""), F.lit("")), F.split(F.lower(F.regexp_replace(before, r"[^\p{L}0-9_]+", " ")), " ")), -4, 4)
    said = {v: F.arrays_overlap(near, F.array(*map(F.lit, words.split()))) for v, words in GAZETTEER[kind].items()}
    bucket = F.when(F.length(m) < 20, 0).when(F.length(m) < 28, 1).when(F.length(m) < 40, 2).otherwise(3)
    kinds = F.size(F.array_distinct(F.split(m, "")))
    variety = F.when(kinds < 6, 0).when(kinds < 11, 1).otherwise(2)
    return F.struct(
        x["s"].alias("s"), x["e"].alias("e"), F.lit(list(ADDED).index(kind)).alias("kind"), shape.alias("shape"), vote(said[1], said[0]).alias("gazetteer"), context.alias("context"), mixed.alias("mixed"),
        bucket.alias("bucket"), variety.alias("variety"), before.rlike("[\"'`“«]$").cast("int").alias("quoted"),
    )


def of_kind_labelled(kind: str):
    return lambda x: labelled(kind, x)


def candidates(docs: DataFrame, text: str, names: dict[str, str]) -> DataFrame:
    """Add the base spans, and under "added" the candidates of the added kinds that touch none of them, with votes."""
    docs = base_spans(docs, text, names)
    t, digit = F.col(text), F.col(names["digit"])
    taken = F.concat(*[F.col(names[k]) for k in BASE])
    title = F.lit(False)
    for word in TITLES:
        title = title | t.contains(word)
    may = {
        "secret": digit & t.rlike("[A-Za-z0-9]{16}"), "number": digit & t.rlike(r"[0-9]{2}\)?[\x20.-][0-9]{2}"), "account": digit & t.rlike("[A-Z]{2}[0-9]{2}"),
        "name": title, "address": digit & t.rlike(r"[0-9]\x20\p{Lu}"),
    }
    found = []
    for kind, pattern in ADDED.items():
        spans = F.when(may[kind], located(t, pattern)).otherwise(F.array().cast(SPAN))
        if kind == "secret":
            spans = F.filter(spans, lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]"))
        found.append(F.transform(free_of(spans, taken), of_kind_labelled(kind)))
    return docs.withColumn(names["added"], F.concat(*found))


def estimate(patterns: list[tuple], rounds: int = 100) -> tuple[dict[tuple, float], dict]:
    """EM over (kind, votes, count): posteriors of private by (kind, votes), and each labeler's reliabilities.

    For every kind a prior, and for every labeler how it votes on private and on
    other candidates, no opinion counting as a vote of its own.  It starts from
    the majority of votes, which tells the two classes apart.
    """
    posterior, reliability = {}, {}
    for kind in sorted({p[0] for p in patterns}):
        rows = [(p[1], p[2]) for p in patterns if p[0] == kind]
        belief = {}
        for votes, _ in rows:
            yes, no = votes.count(1), votes.count(0)
            belief[votes] = (yes + 0.5) / (yes + no + 1.0)
        for _ in range(rounds):
            total = sum(n for _, n in rows)
            private = sum(n * belief[v] for v, n in rows)
            prior = (private + 1) / (total + 2)
            table = {}
            for k in range(len(LABELERS)):
                for value in (-1, 0, 1):
                    hit = sum(n * belief[v] for v, n in rows if v[k] == value)
                    miss = sum(n * (1 - belief[v]) for v, n in rows if v[k] == value)
                    # A labeler is taken to be right more often than wrong: ten pseudo-counts say so.
                    lean = 10.0
                    table[k, value] = (hit + lean * (0.6, 0.3, 0.1)[(1, -1, 0).index(value)]) / (private + lean), (miss + lean * (0.1, 0.3, 0.6)[(1, -1, 0).index(value)]) / (total - private + lean)
            for votes, _ in rows:
                a = math.log(prior) + sum(math.log(table[k, v][0]) for k, v in enumerate(votes))
                b = math.log(1 - prior) + sum(math.log(table[k, v][1]) for k, v in enumerate(votes))
                belief[votes] = 1 / (1 + math.exp(min(700, b - a)))
        posterior |= {(kind, v): p for v, p in belief.items()}
        reliability[kind] = {(LABELERS[k], v): p for (k, v), p in table.items()}
    return posterior, reliability


def features(kind: int, votes: tuple, shapes: tuple) -> list[tuple]:
    """(field, value, kind) of all that a candidate has; weights are a kind's own."""
    return [("kind", kind, kind), *[(LABELERS[k], v, kind) for k, v in enumerate(votes) if v >= 0], *[(SHAPES[k], v, kind) for k, v in enumerate(shapes)]]


def train(rows: list[tuple], posterior: dict[tuple, float], rounds: int = 300, rate: float = 1.0, decay: float = 1e-3) -> dict[tuple, float]:
    """Weights of a logistic classifier from (kind, votes, shapes, count), fitted to the posteriors; each kind counts alike."""
    weights: dict[tuple, float] = {}
    total: dict[int, int] = {}
    for kind, _, _, n in rows:
        total[kind] = total.get(kind, 0) + n
    coded = [(features(k, v, b), posterior[k, v], n / total[k]) for k, v, b, n in rows]
    for _ in range(rounds):
        slope: dict[tuple, float] = {f: -decay * w for f, w in weights.items()}
        for names, target, share in coded:
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, sum(weights.get(f, 0.0) for f in names)))))
            for f in names:
                slope[f] = slope.get(f, 0.0) + share * (target - p)
        for f, x in slope.items():
            weights[f] = weights.get(f, 0.0) + rate * x
    return weights


def score(weights: dict[tuple, float], x: Column) -> Column:
    """The classifier's log-odds of a candidate."""
    out = F.lit(0.0)
    for kind in sorted({k for _, _, k in weights}):
        own = F.lit(0.0)
        for (field, value, of), weight in sorted(weights.items()):
            if of == kind:
                own = own + (F.lit(weight) if field == "kind" else F.when(x[field] == value, weight).otherwise(0.0))
        out = F.when(x["kind"] == kind, own).otherwise(out)
    return out


def names_in(docs: DataFrame) -> dict[str, str]:
    """Names of the columns of findings that ``docs`` doesn't have."""
    return dict(zip((*BASE, "added", "digit"), fresh(docs, *[f"_s_{k}" for k in (*BASE, "added", "digit")])))


def fit(found: DataFrame, added: str) -> dict[tuple, float]:
    """Estimate labelers and train the classifier over all candidates in a table of findings."""
    counted = found.select(F.explode(added).alias("c")).groupBy(*[F.col(f"c.{x}").alias(x) for x in ("kind", *LABELERS, *SHAPES)]).count().collect()
    assert len(counted) <= PATTERNS
    rows = [(r["kind"], tuple(r[x] for x in LABELERS), tuple(r[x] for x in SHAPES), r["count"]) for r in counted]
    by: dict[tuple, int] = {}
    for kind, votes, _, n in rows:
        by[kind, votes] = by.get((kind, votes), 0) + n
    posterior, _ = estimate([(k, v, n) for (k, v), n in sorted(by.items())])
    return train(sorted(rows), posterior)


def chosen(found: DataFrame, weights: dict[tuple, float], added: str) -> DataFrame:
    """The findings with those candidates that the classifier takes for private."""
    return found.withColumn(added, F.filter(F.col(added), lambda x: score(weights, x) > 0))


def listed(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.format_string(f"{kind}:%d:%d", x["s"], x["e"]))


def of_kind(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("k")))


def findings(docs: DataFrame, kept: list[str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The table of base spans and candidates of ``docs(doc_id, text)``, with all its columns or those ``kept``; and its columns' names."""
    names = names_in(docs)
    rows = docs.withColumn("text", F.coalesce(F.col("text"), F.lit(""))) if kept is not None else docs
    found = candidates(rows, "text", names).drop(names["digit"])
    own = [F.col(f"`{c}`") for c in (docs.columns if kept is None else kept)]
    return stored(found.select(*own, *[names[k] for k in (*BASE, "added")]), "findings"), names


def detect(docs: DataFrame, weights: dict[tuple, float] | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_<added>..., n_spans) for each row of ``docs(doc_id, text)``.

    A null or empty text has no spans and the hash of nothing.  Spans of added
    kinds never touch base spans, but may touch each other.  Repeated rows get
    equal rows; other columns, whatever their names, are ignored; an empty table
    gives no rows.  Nothing is shuffled but counts of vote patterns.  A text of
    any length is searched whole; the work grows with its length and number of
    spans.  Without ``weights`` the classifier is fitted to these documents.
    """
    found, names = findings(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"])
    found = chosen(found, fit(found, names["added"]) if weights is None else weights, names["added"])
    base = F.concat(*[listed(F.col(names[k]), k) for k in BASE])
    of = {k: of_kind(F.col(names["added"]), i) for i, k in enumerate(ADDED)}
    found = found.withColumns({"base": base, "more": F.concat(*[listed(of[k], k) for k in ADDED])} | {f"n_{k}": F.size(names[k]).cast("long") for k in BASE} | {f"n_{k}": F.size(of[k]).cast("long") for k in ADDED})
    return found.select(
        "doc_id", *[f"n_{k}" for k in BASE], F.sha2(F.concat_ws(",", "base").cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", "base", "more").alias("spans"), *[f"n_{k}" for k in ADDED], (F.size("base") + F.size("more")).cast("long").alias("n_spans"),
    )


def redacted(docs: DataFrame, weights: dict[tuple, float] | None = None) -> DataFrame:
    """``docs`` with each span in the text replaced by its kind in brackets; a null text stays null.

    Spans that touch are replaced as one, under the kind of the first (base
    kinds come first among equals).  All rows and columns stay, repeated rows
    and columns of any name too.
    """
    found, names = findings(docs)
    found = chosen(found, fit(found, names["added"]) if weights is None else weights, names["added"])
    labels = F.array(*map(F.lit, ADDED))
    every = F.concat(
        *[named(F.col(names[k]), k) for k in BASE],
        F.transform(F.col(names["added"]), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.element_at(labels, x["kind"] + 1).alias("k"))),
    )
    kind = "struct<s:int,e:int,k:string>"
    grown = Grown(kind)

    def merge(seen: Column, x: Column) -> Column:
        last = seen["last"]
        touches = last.isNotNull() & (x["s"] < last["e"])
        joined = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["k"].alias("k"))
        return F.struct(F.when(touches, joined).otherwise(x).alias("last"), *grown.add(seen, last, last.isNotNull() & ~touches))

    rest = lambda seen: F.when(seen["last"].isNotNull(), F.array(seen["last"])).otherwise(F.array().cast(f"array<{kind}>"))
    merged = F.aggregate(F.array_sort(every), F.struct(F.lit(None).cast(kind).alias("last"), *grown.start()), merge, lambda seen: F.concat(grown.all(seen), rest(seen)))
    found = found.withColumn(names["digit"], merged)
    t, spans = F.col("text"), F.col(names["digit"])
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda x: x["e"]))
    parts = F.transform(F.arrays_zip(spans.alias("x"), ends.alias("at")), lambda z: F.when(z["x"].isNotNull(), F.concat(F.substring(t, z["at"] + 1, z["x"]["s"] - z["at"]), F.lit("["), F.upper(z["x"]["k"]), F.lit("]"))))
    tail = F.substring(t, F.element_at(ends, -1) + 1, F.length(t))
    text = F.when(F.size(spans) > 0, F.concat(F.concat_ws("", parts), tail)).otherwise(t)
    return found.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])


def op4(spark, sf_dir):
    return detect(documents(spark, sf_dir))
