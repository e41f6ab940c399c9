"""Personal data: candidate spans judged by gradient-boosted trees, in DataFrame functions only.

Fixed patterns give the base spans.  In what they leave, generators of high recall propose overlapping candidates (written-out
mail addresses, account numbers, and several shapes of digit groups, so that a run of groups is proposed in parts as well);
boosted trees look at each candidate's format and at the nearest context words in up to ``AROUND`` characters on both sides of it.  Those whose
margin reaches a threshold calibrated on held-out rows are personal; of overlapping ones the best-scoring stays.

The trees are trained once a process on generated labelled rows (``labelled_examples``: ``ROWS`` rows from fixed
templates, the bound of the training set) by Spark ML and turned into one Column expression, so candidates are
judged inside their row: the texts are neither shuffled nor handed to Python.  The threshold comes from rows of templates
that training doesn't see.

Defined cases: a null text has no spans (and stays null in ``redact``); equal rows get equal results; matches that
fail their rule are dropped and not tried again from inside; texts of any length are read whole; of other columns than doc_id and
text none is read, whatever it is called.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, quoted
from .quality import let

#: Labelled rows generated for training, and for calibration, and the precision that the threshold must reach on the latter.
ROWS, HELD_OUT, PRECISION = 1500, 700, 0.99
#: Characters on each side of a candidate in which context words count.
AROUND = 64
#: Elements of an array that one step of a running sum goes over.
BLOCK = 128

# The base patterns in the order in which kinds are listed.  Possessive forms match the same as the
# plain ones, since what follows each of them can't be matched by it; the look-behind skips starts inside a run
# whose start has failed already.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"

#: The generators: kind, pattern, and what a text must hold for it to match.  Separators are bounded and ends lie at group borders.
_DIGITS = "[0-9]"
GENERATORS = (
    ("mail", r"[A-Za-z0-9][A-Za-z0-9._-]*+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++ ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,}+", r"[)\]]|\x20dot\x20"),
    ("account", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}"),
    ("number", r"(?<![A-Za-z0-9])[0-9]{7,}+(?![A-Za-z0-9])", _DIGITS),
    ("number", r"(?<![A-Za-z0-9])[0-9]{3}[\x20.-][0-9]{2}[\x20.-][0-9]{4}(?![A-Za-z0-9])", _DIGITS),
    ("number", r"(?<![A-Za-z0-9(])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![A-Za-z0-9])", _DIGITS),
    ("number", r"(?<![A-Za-z0-9])[0-9]{1,5}(?:[\x20.-][0-9]{2,6}){1,5}+(?![A-Za-z0-9])", _DIGITS),
)
KINDS = ("email", "ip", "card", "phone", "mail", "account", "number")
#: Context words by what they speak of.
_CONTEXT = {
    "phone": "phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|handy|tél|téléphone|móvil|teléfono|text me|reach (?:me|us|him|her|them) (?:at|on)",
    "identity": "ssn|social security|passport|driver|license|licence|taxpayer|tax|patient|insurance|nif|dni|ausweis|reisepass|pasaporte|passeport",
    "bank": "account|acct|iban|bank|card|konto|cuenta|compte",
    "mail": "mail|e-mail|contact|write|reach|kontakt|contacto",
    "other": "order|invoice|version|page|chapter|isbn|part|model|model no|serial|population|year|ticket|issue|code|lot|item|about|some|over|room|row|batch|shipment|receipt|case|section",
}
_ANY = "|".join(_CONTEXT.values())
#: The text from the last context word on; up to the end of the first one.
_LAST, _FIRST = rf"(?is)^.*\b((?:{_ANY})\b.*)$", rf"(?is)^.*?\b({_ANY})\b"
_ENDING = r"(?i)\b(?:com|org|net|edu|gov|info|io|co|eu|de|at|ch|fr|es|it|uk|us)$"
FEATURES = (
    "kind", "length", "digits", "letters", "separators", "groups", "spaces", "dots", "first_group", "last_group", "digits_beside", "known_ending", "gap", "digits_between", *(f"{w}_{where}" for where in ("before", "after") for w in _CONTEXT)
)


def running_sums(values: Column) -> Column:
    """An array of the sums of all values before each one, in blocks so that long arrays stay far from quadratic."""

    def within(part: Column, start: Column) -> Column:
        return F.transform(part, lambda _, j: start + F.aggregate(F.slice(part, F.lit(1), j), F.lit(0), lambda a, x: a + x))

    def over(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))
        return let(blocks, lambda b: let(F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)), lambda sums: F.flatten(F.transform(b, lambda part, k: within(part, F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0), lambda a, y: a + y))))))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(values, over))


def running_max(values: Column) -> Column:
    """An array of the largest value before each one, 0 for the first, in blocks like those of running_sums."""

    def most(part: Column, start: Column) -> Column:
        return F.aggregate(part, start, lambda a, x: F.greatest(a, x))

    def over(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, F.lit(BLOCK)))
        within = lambda part, start: F.transform(part, lambda _, j: most(F.slice(part, F.lit(1), j), start))
        return let(blocks, lambda b: let(F.transform(b, lambda x: most(x, F.lit(0))), lambda tops: F.flatten(F.transform(b, lambda part, k: within(part, most(F.slice(tops, F.lit(1), k), F.lit(0)))))))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(values, over))


_PLAIN, _AROUND = "array<struct<s:int,e:int,m:string>>", "array<struct<s:int,e:int,m:string,before:string,after:string>>"


def matches(text: Column, pattern: str, around: int = 0) -> Column:
    """Array of structs (s, e, m): start, end and string of each match, in code points, from left to right; if asked for, with
    up to around characters before and after it, which reach over one more match on each side.  Everything comes from the pieces between matches, in
    time linear in the text."""
    kind = _AROUND if around else _PLAIN

    def placed(m: Column) -> Column:
        def of(pieces: Column) -> Column:
            steps = F.zip_with(F.slice(pieces, 1, F.size(m)), m, lambda p, x: F.length(p) + F.length(x))

            def one(z: Column, i: Column) -> Column:
                fields = [(z["b"] + z["w"] - F.length(z["m"])).alias("s"), (z["b"] + z["w"]).alias("e"), z["m"].alias("m")]
                if around:
                    join = lambda *parts: F.concat(*(F.coalesce(p, F.lit("")) for p in parts))
                    before = F.right(join(F.right(F.get(pieces, i - 1), F.lit(around)), F.get(m, i - 1), F.right(F.get(pieces, i), F.lit(around))), F.lit(around))
                    after = F.left(join(F.left(F.get(pieces, i + 1), F.lit(around)), F.get(m, i + 1), F.left(F.get(pieces, i + 2), F.lit(around))), F.lit(around))
                    fields += [before.alias("before"), after.alias("after")]
                return F.struct(*fields)

            return let(steps, lambda st: F.transform(F.arrays_zip(running_sums(st).alias("b"), st.alias("w"), m.alias("m")), one))

        return let(F.split(text, pattern, -1), of)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda m: F.when(F.size(m) == 0, F.array().cast(kind)).otherwise(placed(m).cast(kind)))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def _bare(found: Column, k: int) -> Column:
    """Matches as spans (s, k, e) of kind k."""
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))


def _where(cheap: Column, found: Column, kind: str = _PLAIN) -> Column:
    """found where a cheap test of something that no match can do without holds, else no match."""
    return F.when(cheap, found).otherwise(F.array().cast(kind))


def feature_columns(kind: Column, m: Column, before: Column, after: Column) -> list[Column]:
    """Format and context features of a candidate, in the order of FEATURES.

    Context is the nearest context word: the last one before the candidate in its sentence and line, with how far back it is and whether
    digits lie between (then it may speak of another number), and the first one after it, before any digit, comma or semicolon.
    """

    def count(pattern: str) -> Column:
        return F.length(F.regexp_replace(m, f"[^{pattern}]", ""))

    sentence = F.regexp_replace(before, r"(?s)^.*(?:[!?\n]|\.\s++(?=\p{Lu}))", "")
    rest = F.regexp_replace(after, r"(?s)(?:[!?\n,;0-9]|\.\s++(?=\p{Lu})).*$", "")
    told, named = F.regexp_extract(sentence, _LAST, 1), F.regexp_extract(rest, _FIRST, 1)
    digit_groups = F.split(F.regexp_replace(m, r"^[^0-9A-Za-z]+|[^0-9A-Za-z]+$", ""), r"[^0-9A-Za-z]+")
    return [
        *(x.cast("double") for x in (kind, F.length(m), count("0-9"), count("A-Za-z"), count(r"\x20().-"), F.size(digit_groups), count(r"\x20"), count("."), F.length(F.get(digit_groups, F.lit(0))), F.length(F.get(digit_groups, F.size(digit_groups) - 1)), F.regexp_like(before, F.lit(r"[0-9][\x20.-]$")).cast("int") + F.regexp_like(after, F.lit(r"^[\x20.-][0-9]")).cast("int"), F.regexp_like(m, F.lit(_ENDING)).cast("int"))),
        F.length(told).cast("double"),
        F.regexp_like(told, F.lit("[0-9]")).cast("double"),
        *(F.regexp_like(where, F.lit(rf"(?i)^(?:{p})\b")).cast("double") for where in (told, named) for p in _CONTEXT.values()),
    ]


def labelled_examples(rows: int = ROWS, held_out: bool = False) -> list[tuple[int, str, str, str, float]]:
    """(kind number, candidate, text before it, text after it, 1 if personal) rows from fixed templates.  Held-out rows come from other
    templates of formats and of sentences than the rest."""
    import random

    r = random.Random(23 if held_out else 11)
    mail, account, number = (KINDS.index(k) for k in ("mail", "account", "number"))
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice(["the", "er", "on", "an", "re", "in", "ed", "nd", "st", "ou", "en", "ch", "la", "de", "ver", "eau", "ung", "os"]) for _ in range(r.randint(1, 4)))
    some = lambda lo, hi: "".join(w() + " " for _ in range(r.randint(lo, hi)))
    # what stands between a context word and the candidate, and what follows it
    link = lambda: r.choice(["", ": ", " is ", " no. ", " number ", " number: ", f" of {w()} is ", f" {w()} {w()} ", " "]).join(["", ""]) or " "
    tail = lambda: r.choice(["", ".", ", ", " ", ". "]) + some(0, 6)
    links = ["=", " was given as ", f" of {w()} {w()} ", " - ", " #"] if held_out else None

    def told(words: list[str], where: str = "both") -> tuple[str, str]:
        """Text before and after with one of the words in it."""
        word = r.choice(words)
        if where == "after" or (where == "both" and r.random() < 0.2):
            return some(1, 6), r.choice([" is my ", " is the ", " (", ", "]) + word + tail()
        return some(0, 5) + word + (r.choice(links) if links else link()), tail()

    def untold() -> tuple[str, str]:
        return some(1, 8), tail()

    phone = ["Rückruf unter Telefon", "fax", "call me at", "cell"] if held_out else ["phone", "tel", "Tel.", "call", "mobile", "telephone", "téléphone", "móvil", "telefon", "whatsapp", "text me on"]
    identity = ["passport", "patient", "tax", "dni"] if held_out else ["ssn", "SSN", "social security", "passport", "driver license", "taxpayer", "tax", "insurance", "patient", "reisepass", "nif"]
    bank = ["bank", "compte"] if held_out else ["account", "acct", "iban", "IBAN", "bank", "konto", "cuenta"]
    write = ["reach me:", "contacto"] if held_out else ["mail", "e-mail", "contact", "write to", "kontakt"]
    other = ["serial", "lot", "over", "ticket", "chapter"] if held_out else ["order", "invoice", "version", "page", "isbn", "part", "model", "population", "year", "issue", "item", "about", "code", "some"]
    domain = lambda: r.choice(["com", "org", "de", "net", "es", "fr"])
    phones = [lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"0{d(3)} {d(6)}", lambda: d(10), lambda: f"0{d(2)}/{d(7)}", lambda: f"{d(3)}-{d(4)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"]
    if held_out:
        phones = [lambda: f"{d(3)} {d(3)} {d(4)}", lambda: f"({d(4)}) {d(6)}", lambda: f"0{d(4)}-{d(6)}", lambda: d(11)]
    personal = [
        lambda: (mail, f"{w()}.{w()} (at) {w()} (dot) {domain()}", *r.choice([untold, lambda: told(write)])()),
        lambda: (mail, f"{w()}[at]{w()}[dot]{domain()}", *r.choice([untold, lambda: told(write)])()),
        lambda: (mail, f"{w()} at {w()} dot {domain()}", *told(write)),
        lambda: (account, f"{r.choice(['DE', 'AT', 'NL'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", *r.choice([untold, lambda: told(bank)])()),
        lambda: (account, f"{r.choice(['FR', 'ES', 'GB', 'IT'])}{d(18)}", *told(bank)),
        lambda: (number, f"{d(3)}-{d(2)}-{d(4)}", *r.choice([untold, lambda: told(identity)])()),
        lambda: (number, f"{d(3)} {d(2)} {d(4)}", *told(identity)),
        lambda: (number, r.choice(phones)(), *told(phone)),
        lambda: (number, r.choice(phones)(), *told(phone)),
        lambda: (number, f"({d(3)}) {d(3)}-{d(4)}", *untold()),
        lambda: (number, d(10), some(0, 3) + r.choice(phone) + f" {d(10)} ", tail()),
        lambda: (number, r.choice([d(8), d(9), d(11)]), *told(identity)),
        lambda: (number, r.choice([d(8), d(10), d(12), f"{d(4)} {d(4)} {d(2)}"]), *told(bank)),
    ]
    harmless = [
        lambda: (mail, f"{w()} at {w()} dot {w()}", *untold()),
        lambda: (account, f"{r.choice(['AB', 'XK', 'QT'])}{d(2)}{w().upper()[:4]:A<4}{d(4)}", *r.choice([untold, lambda: told(other)])()),
        lambda: (number, d(r.randint(7, 20)), *untold()),
        lambda: (number, d(r.randint(7, 20)), *told(other, "before")),
        lambda: (number, f"{r.randint(1900, 2099)}-{r.randint(10, 12)}-{r.randint(10, 28)}", *untold()),
        lambda: (number, f"{r.randint(1900, 2099)}-{r.randint(1900, 2099)}", *r.choice([untold, lambda: told(other)])()),
        lambda: (number, f"{d(1)}.{d(2)}.{d(3)}.{d(4)}", *told(other)),
        lambda: (number, f"{d(3)}.{d(6)}", *r.choice([untold, lambda: told(other)])()),
        lambda: (number, f"{d(1)}.{d(3)}.{d(3)}", *r.choice([untold, lambda: told(other)])()),
        lambda: (number, " ".join(d(r.randint(2, 4)) for _ in range(r.randint(2, 6))), *untold()),
        lambda: (number, "-".join(d(r.randint(2, 6)) for _ in range(r.randint(2, 5))), *told(other, "before")),
        lambda: (number, f"{d(4)} {d(4)} {d(4)} {d(4)}", *untold()),
        lambda: (number, r.choice([f"{d(3)} {d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(4)}-{d(4)}"]), *told(other, "before")),
        lambda: (number, d(r.randint(21, 300)), *untold()),
        lambda: (number, r.choice([f"{d(4)} {d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(4)} {d(4)} {d(4)}", d(8)]), f"{some(1, 5)}{d(r.randint(2, 6))} ", tail()),
        lambda: (number, r.choice([f"{d(4)} {d(4)}", f"{d(2)} {d(3)} {d(4)}", f"{d(4)} {d(4)} {d(4)}", d(9)]), some(1, 6), f" {d(r.randint(2, 6))} " + some(0, 4)),
    ]
    words = phone + identity + bank + other
    clause = lambda: f"{r.choice(words)}{link()}{r.choice([d(8), d(9), d(10), d(6), f'{d(3)}-{d(2)}-{d(4)}', r.choice(phones)()])}"
    joints = [" or ", " / ", " while "] if held_out else [", ", "; ", " and ", ", and "]

    def beside(kind: int, m: str, before: str, after: str) -> tuple[int, str, str, str]:
        """Half of the rows stand in a sentence with other numbers, of which context words speak that say nothing of this one."""
        if r.random() < 0.5:
            before = some(0, 2) + clause() + r.choice(joints) + before
        if r.random() < 0.5:
            after = r.choice(joints) + clause() + r.choice(["", ".", " "])
        return kind, m, before, after

    def made(make: Callable[[], tuple]) -> tuple[int, str, str, str]:
        row = make()
        # a word behind the candidate that the row relies on stays there
        return row if row[3][:1] == " " and re.search(_FIRST, row[3]) or r.random() < 0.3 else beside(*row)

    return [(*made(make), label) for k in range(rows // 2) for label, makes in ((1.0, personal), (0.0, harmless)) for make in [makes[k % len(makes)]]]


@lru_cache(maxsize=1)
def trained() -> tuple[list, float]:
    """(trees as nested tuples, margin from which a candidate is personal); trained by Spark ML, once a process."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    spark = SparkSession.getActiveSession()

    def featured(rows: list) -> DataFrame:
        made = spark.createDataFrame(rows, "kind int, m string, before string, after string, label double").coalesce(1)
        return made.select("label", *(c.alias(n) for c, n in zip(feature_columns(F.col("kind"), F.col("m"), F.col("before"), F.col("after")), FEATURES, strict=True)))

    made = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured(labelled_examples())).select("features", "label").cache()
    model = GBTClassifier(maxIter=14, maxDepth=4, stepSize=0.4, seed=1, labelCol="label").fit(made)
    made.unpersist()
    trees = [(w, parse_tree(t.toDebugString)) for w, t in zip(model.treeWeights, model.trees, strict=True)]
    held_out = featured(labelled_examples(HELD_OUT, held_out=True)).select("label", margin(trees, {n: F.col(n) for n in FEATURES}).alias("x")).collect()  # HELD_OUT rows
    ordered = sorted(((r["x"], r["label"]) for r in held_out), reverse=True)
    best, right = float("inf"), 0.0
    for n, (x, label) in enumerate(ordered, 1):
        right += label
        if right / n >= PRECISION and (n == len(ordered) or ordered[n][0] < x):
            best = x
    return trees, best


def parse_tree(printed: str) -> tuple:
    """(feature, threshold, left, right) or (prediction,) from Spark ML's description of a tree."""
    lines = iter(printed.splitlines()[1:])

    def node() -> tuple:
        line = next(lines).strip()
        if line.startswith("Predict:"):
            return (float(line.split(":")[1]),)
        feature, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        left = node()
        next(lines)  # Else
        return int(feature), float(threshold), left, node()

    return node()


def margin(trees: list, features: dict[str, Column]) -> Column:
    def of(node: tuple) -> Column:
        if len(node) == 1:
            return F.lit(node[0])
        return F.when(features[FEATURES[node[0]]] <= node[1], of(node[2])).otherwise(of(node[3]))

    total = F.lit(0.0)
    for weight, tree in trees:
        total = total + weight * of(tree)
    return total


def with_spans(df: DataFrame, text: str, base: str, spans: str) -> DataFrame:
    """df with two more columns of sorted arrays of (s, k, e), k the number of the kind: the base spans, and all spans."""
    trees, least = trained()
    t = F.col(text)
    digit = F.regexp_like(t, F.lit("[0-9]"))

    def card(x: Column) -> Column:
        return let(digits_of(x["m"]), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))

    df = df.withColumn(base, F.sort_array(F.concat(
        _bare(_where(F.contains(t, F.lit("@")), matches(t, EMAIL)), 0),
        _bare(F.filter(_where(digit, matches(t, IP)), lambda x: F.regexp_like(x["m"], F.lit(_OCTETS))), 1),
        _bare(F.filter(_where(digit, matches(t, CARD)), card), 2),
        _bare(F.filter(_where(F.contains(t, F.lit("+")), matches(t, PHONE)), lambda x: F.length(digits_of(x["m"])).between(9, 15)), 3),
    )))
    # base spans become line feeds, at which candidates and their context end
    left = fresh_name(df.columns, "left")
    df = df.withColumn(left, F.when(F.regexp_like(t, F.lit(r"[0-9]|[)\]]|\x20dot\x20")), rebuilt(t, F.col(base), lambda x, before: F.repeat(F.lit("\n"), x["e"] - F.greatest(x["s"], before)))).otherwise(F.lit("")))

    def proposed(k: int, pattern: str, needed: str) -> Column:
        found = _where(F.regexp_like(F.col(left), F.lit(needed)), matches(F.col(left), pattern, AROUND), _AROUND)
        return F.transform(F.filter(found, lambda x: F.length(digits_of(x["m"])) >= 7) if k == KINDS.index("number") else found, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after")))

    def judged(x: Column) -> Column:
        named = F.struct(*(c.alias(n) for c, n in zip(feature_columns(x["k"], x["m"], x["before"], x["after"]), FEATURES, strict=True)))
        return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), let(named, lambda f: margin(trees, {n: f[n] for n in FEATURES})).alias("x"))

    def best(done: Column, x: Column) -> Column:
        """The spans so far, of which the last one gives way to an overlapping one of a higher score."""
        last = F.get(done, F.size(done) - 1)
        return F.when(F.coalesce(x["s"] >= last["e"], F.lit(True)), F.concat(done, F.array(x))).when(x["x"] > last["x"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(x))).otherwise(done)

    every = F.array_distinct(F.concat(*(proposed(KINDS.index(name), pattern, needed) for name, pattern, needed in GENERATORS)))
    personal = F.sort_array(F.filter(F.transform(every, judged), lambda x: x["x"] >= least))
    chosen = let(personal, lambda p: F.when(F.size(p) < 2, p).otherwise(F.aggregate(p, F.array().cast("array<struct<s:int,k:int,e:int,x:double>>"), best)))
    added = F.when(F.col(left) == "", F.array().cast("array<struct<s:int,k:int,e:int>>")).otherwise(F.transform(chosen, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    return df.withColumn(spans, F.sort_array(F.concat(F.col(base), added))).drop(left)


def rebuilt(text: Column, spans: Column, put: Callable[[Column, Column], Column]) -> Column:
    """text with put(span, where the spans before it end) in place of each of the sorted spans, which may overlap."""

    def piece(z: Column) -> Column:
        start = F.coalesce(F.substring(text, z["b"] + 1, z["x"]["s"] - z["b"]), F.lit(""))
        return F.concat(F.when(z["x"]["s"] > z["b"], start).otherwise(F.lit("")), put(z["x"], z["b"]))

    def of(x: Column) -> Column:
        pieces = F.transform(F.arrays_zip(x.alias("x"), running_max(F.transform(x, lambda y: y["e"])).alias("b")), piece)
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.array_max(F.transform(x, lambda y: y["e"])) + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, of))


def written(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kinds[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_model of every document."""
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = with_spans(asked, "text", "base", "every")

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")

    return found.select(
        "doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("every")).alias("spans"), (F.size("every") - F.size("base")).cast("long").alias("n_model")
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced (and n_chars brought up to date); all rows and columns stay."""
    text, base, spans = (fresh_name(docs.columns, f"pii_{x}") for x in ("text", "base", "spans"))
    out = with_spans(docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit(""))), text, base, spans)
    named = lambda x, before: F.when(x["s"] >= before, F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))[x["k"]]).otherwise(F.lit(""))
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), rebuilt(F.col(text), F.col(spans), named)))
    return (out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out).select(*quoted(docs.columns))
