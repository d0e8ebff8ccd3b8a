r"""Personal data: rule-based spans, and candidates chosen by boosted trees.

High-recall generators propose spans, which may overlap: those of the four base kinds, which are checked by rule and always kept, and long
mixed tokens, digit groups and account numbers. The trees see a candidate's format and the words before it, and a threshold for each
generator, calibrated on examples that the trees have not seen, selects among them. All of it is SQL expressions on one row: no shuffle.

Positions come from the pieces between the matches. The base patterns are written possessively, and those that begin with a run look back,
so a long run is read once; the spans are those of the plain patterns.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting

# The base patterns, and cheap tests without which no match can be.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Generators beside the base ones.
MORE = {
    "secret": r"(?<![0-9A-Za-z_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[0-9A-Za-z_-]{12,}+",
    "number": r"(?<![0-9A-Za-z])[0-9](?:[ .-]?[0-9]){6,}+(?![0-9A-Za-z])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![0-9A-Za-z])",
}
NEEDED = {
    "email": "@",
    "phone": "+",
}
KINDS = (*BASE, *MORE)
BEFORE = 30  #: characters of context before a candidate

#: Features of a candidate ``x``: ``x.m`` is its text, ``x.b`` the lower-cased text before it, ``x.k`` its kind's number.
FEATURES = {
    "length": "length(x.m)",
    "digits": "length(regexp_replace(x.m, '[^0-9]', ''))",
    "letters": "length(regexp_replace(x.m, '[^A-Za-z]', ''))",
    "capitals": "length(regexp_replace(x.m, '[^A-Z]', ''))",
    "digit_runs": "regexp_count(x.m, '[0-9]+')",
    "hexadecimal": "cast(x.m rlike '^[0-9a-fA-F]+$' as int)",
    "near_secret": "cast(x.b rlike 'token|secret|passw|pwd|key|auth|bearer|credential' as int)",
    "near_identity": "cast(x.b rlike 'ssn|social|passport|national|insurance|tax|ident' as int)",
    "near_account": "cast(x.b rlike 'iban|account|acct|konto|compte|cuenta|bank' as int)",
    "near_call": "cast(x.b rlike 'tel|phone|call|mobile|fax|dial' as int)",
    "assigned": "cast(x.b rlike '[=:][ \"]*$' as int)",
    "family": "x.k",
    "identity_shape": "cast(x.m rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$' as int)",
    "date_shape": "cast(x.m rlike '^[0-9]{4}[.-][0-9]{2}[.-][0-9]{2}$|^[0-9]{1,2}[.-][0-9]{1,2}[.-][0-9]{4}$' as int)",
}


def spans_of(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<s, e, m>>``: code points, end exclusive."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    each = F.arrays_zip(gaps.alias("gap"), found.alias("m"))
    empty = F.expr("struct(0 as at, cast(array() as array<struct<s: int, e: int, m: string>>) as spans)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m")))).alias("spans"))

    return F.aggregate(F.slice(each, F.lit(1), F.size(found)), empty, step, lambda acc: acc["spans"])


def no_spans() -> Column:
    return F.expr("cast(array() as array<struct<s: int, e: int, m: string>>)")


def valid(kind: str) -> str:
    """What a match ``x.m`` of a base kind must satisfy."""
    digits = "length(regexp_replace(x.m, '[^0-9]', ''))"
    return {
        "email": "true",
        "ip": f"x.m rlike '^(?:{PART}[.]){{3}}{PART}$'",
        "card": f"{digits} between 12 and 19 and luhn_check(regexp_replace(x.m, '[^0-9]', ''))",
        "phone": f"{digits} between 9 and 15",
    }[kind]


def examples(n: int, seed: int) -> list[tuple[str, str, str, int]]:
    """Labelled candidates (generator, text, text before, personal or secret), made up by rule: both formats and contexts vary, so neither decides alone."""
    r = random.Random(seed)
    pick = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    hexa, digit, alnum, upper = "0123456789abcdef", "0123456789", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = lambda: pick("aeioubcdfghlmnprst", r.randint(2, 8))
    plain = lambda: r.choice([f"{word()} {word()} ", f"{word()}, {word()} ", f"see {word()} no. ", f"{word()}: ", f"{word()} ("])
    secret_lead = lambda: r.choice(['token = "', "password=", "secret: ", "api_key=", "auth bearer ", 'access key "', "pwd: "])
    made = []
    for _ in range(n):
        case = r.randrange(12)
        if case in (0, 1):
            made.append(("secret", pick(r.choice([hexa, alnum]), r.choice([16, 18, 20, 32, 40, 64])), f"{word()} {secret_lead()}", 1))
        elif case == 2:
            made.append(("secret", pick(hexa, r.choice([32, 40, 64])), plain(), r.choice([1, 1, 1, 0])))
        elif case in (3, 4):
            made.append(("secret", r.choice([f"{word()}-{word()}-{pick(digit, 2)}", f"{word()}{word()}{pick(digit, r.randint(1, 4))}", f"{pick(upper, 3)}-{pick(digit, 4)}-{word()}{word()}", f"{pick(digit, 4)}-{pick(digit, 2)}-{pick(digit, 2)}T{pick(digit, 4)}"]), r.choice([plain(), plain(), f"{word()} key "]), 0))
        elif case == 5:
            made.append(("number", f"{pick(digit, 3)}-{pick(digit, 2)}-{pick(digit, 4)}", r.choice([plain(), "social security ", "ssn: "]), 1))
        elif case == 6:
            made.append(("number", r.choice([pick(digit, 9), pick(digit, 11), f"{pick(digit, 4)} {pick(digit, 4)} {pick(digit, 3)}"]), r.choice(["passport ", "national insurance ", "tax id ", "bank account ", "konto "]), 1))
        elif case == 7:
            made.append(("number", r.choice([f"{pick(digit, 3)} {pick(digit, 3)} {pick(digit, 4)}", f"{pick(digit, 3)}-{pick(digit, 3)}-{pick(digit, 4)}"]), r.choice(["call ", "phone: ", "tel. ", "mobile "]), 1))
        elif case in (8, 9):
            made.append(("number", r.choice([f"20{pick(digit, 2)}-{pick(digit, 2)}-{pick(digit, 2)}", pick(digit, r.randint(7, 12)), pick(digit, r.randint(13, 19)), " ".join(pick(digit, 4) for _ in range(4)), f"{r.randint(1, 99)} {pick(digit, 3)} {pick(digit, 3)}", f"{pick(digit, 1)}.{pick(digit, 2)}.{pick(digit, 4)}", f"{pick(digit, 3)} {pick(digit, 3)} {pick(digit, 4)}"]), plain(), 0))
        elif case == 10:
            made.append(("account", pick(upper, 2) + pick(digit, 2) + r.choice([pick(digit, 18), pick(digit, 16), " " + " ".join(pick(digit, 4) for _ in range(4))]), r.choice([plain(), "iban ", "account: "]), 1))
        else:
            made.append(("account", pick(upper, 2) + pick(digit, 2) + pick(upper + digit, 8), plain(), 0))
    return made


_fitted: dict[tuple[int, int], tuple[str, dict[str, float]]] = {}


def fitted(spark: SparkSession, rows: int = 3000, seed: int = 11) -> tuple[str, dict[str, float]]:
    """The trees' margin as SQL and the threshold by kind; trees fit on half of ``rows`` examples, thresholds on the rest. Kept for the session."""
    if (rows, seed) not in _fitted:
        made = examples(rows, seed)
        table = spark.createDataFrame([(i, KINDS.index(k), m, b.lower()[-BEFORE:]) for i, (k, m, b, _) in enumerate(made)], "i int, k int, m string, b string")
        seen = table.select("i", F.struct("k", "m", "b").alias("x")).select("i", *(F.expr(e).cast("double").alias(n) for n, e in FEATURES.items())).orderBy("i").collect()  # ``rows`` rows
        x, y = np.array([r[1:] for r in seen]), np.array([label for *_, label in made], float)
        half = len(y) // 2
        model = boosting.boost(x[:half], y[:half])
        held, labels, kinds = boosting.margin(model, x[half:]), y[half:], x[half:, [*FEATURES].index("family")]
        cut = {k: boosting.calibrated_threshold(held[kinds == KINDS.index(k)], labels[kinds == KINDS.index(k)], 0.97) for k in MORE}
        _fitted[rows, seed] = boosting.sql(model, [f"x.{n}" for n in FEATURES]), cut
    return _fitted[rows, seed]


def find_personal_data(docs: DataFrame, *, text_col: str = "text", to: str = "pii") -> DataFrame:
    """``docs`` with column ``to``: an array of ``struct<s, k, e, kind, m>`` by start, then kind; code points, end exclusive.

    Kinds are email, ip, card and phone, always kept, and secret, number and account, which the trees choose; of chosen spans that
    overlap the one with the higher margin stays, and none overlaps a base span. A null or empty text has no spans. Equal texts have equal
    spans. A column of the name ``to`` is replaced; others stay as they are.
    """
    margin, cut = fitted(docs.sparkSession)
    names = {k: f"__pii_{k}" for k in (*KINDS, "text", "base", "more", "chosen")}
    df = docs.withColumn(names["text"], F.coalesce(F.col(text_col), F.lit("")))
    text = F.col(names["text"])
    for kind, pattern in (BASE | MORE).items():
        there = text.rlike(pattern)
        if kind in NEEDED:
            there = text.contains(NEEDED[kind]) & there
        df = df.withColumn(names[kind], F.when(there, spans_of(text, pattern)).otherwise(no_spans()))
    base = [f"transform(filter({names[k]}, x -> {valid(k)}), x -> struct(x.s as s, {i} as k, x.e as e, '{k}' as kind, x.m as m))" for i, k in enumerate(BASE)]
    df = df.withColumn(names["base"], F.expr(f"concat({', '.join(base)})"))
    more = [f"transform({names[k]}, x -> struct(x.s as s, {KINDS.index(k)} as k, x.e as e, '{k}' as kind, x.m as m))" for k in MORE]
    more = f"filter(concat({', '.join(more)}), x -> not exists({names['base']}, y -> y.s < x.e and x.s < y.e))"
    before = f"lower(substring({names['text']}, greatest(x.s - {BEFORE}, 0) + 1, least(x.s, {BEFORE})))"
    df = df.withColumn(names["more"], F.expr(f"transform({more}, x -> struct(x.s as s, x.k as k, x.e as e, x.kind as kind, x.m as m, {before} as b))"))
    seen = ", ".join(f"{e} as {n}" for n, e in FEATURES.items())
    scored = f"transform(transform({names['more']}, x -> struct(x.s as s, x.k as k, x.e as e, x.kind as kind, x.m as m, {seen})), x -> struct(x.s as s, x.k as k, x.e as e, x.kind as kind, x.m as m, {margin} as z))"
    least = reduce(lambda rest, k: f"CASE WHEN x.kind = '{k}' THEN {cut[k]!r}D ELSE {rest} END", MORE, "1e9D")
    df = df.withColumn(names["chosen"], F.expr(f"CASE WHEN size({names['more']}) > 0 THEN filter({scored}, x -> x.z >= {least}) END"))
    better = "(y.z > x.z or (y.z = x.z and (y.s < x.s or (y.s = x.s and y.k < x.k))))"
    chosen = f"transform(filter({names['chosen']}, x -> not exists({names['chosen']}, y -> y.s < x.e and x.s < y.e and {better})), x -> struct(x.s as s, x.k as k, x.e as e, x.kind as kind, x.m as m))"
    df = df.withColumn(to, F.expr(f"array_sort(CASE WHEN size({names['chosen']}) > 0 THEN concat({names['base']}, {chosen}) ELSE {names['base']} END)"))
    return df.drop(*names.values())


def redact(docs: DataFrame, *, text_col: str = "text", spans: str = "pii") -> DataFrame:
    """``docs`` with each span of column ``spans`` replaced by its kind in brackets in ``text_col``; a span that begins inside an earlier one goes with that. Null texts stay null."""
    step = (
        f"(acc, x) -> struct(greatest(acc.at, x.e) as at, CASE WHEN x.s >= acc.at THEN concat(acc.out, array(substring({text_col}, acc.at + 1, x.s - acc.at), concat('[', upper(x.kind), ']'))) ELSE acc.out END as out)"
    )
    pieces = f"aggregate({spans}, struct(0 as at, cast(array() as array<string>) as out), {step}, acc -> concat(array_join(acc.out, ''), substring({text_col}, acc.at + 1)))"
    return docs.withColumn(text_col, F.when(F.size(spans) > 0, F.expr(pieces)).otherwise(F.col(text_col)))
