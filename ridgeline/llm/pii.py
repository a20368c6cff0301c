"""Personal data: exact base patterns and boosted candidate spans.

Base spans are the leftmost non-overlapping matches of one pattern per kind
that pass its test.  High-recall generators propose further spans - spelled-out
mail addresses, domestic phone numbers, IPv6 addresses, grouped card numbers,
and keys and tokens as a kind of their own - which may overlap.  Boosted trees
over format and context features give each a probability, and a threshold per
kind, calibrated on held-out training rows, selects.  Selected spans that
overlap a base span or a better candidate go.

Everything over texts is a DataFrame expression; the trees are fitted on the
driver from a fixed synthetic set of ``TRAIN_ROWS`` spans and compiled to CASE
expressions.

The patterns are written so that they run in linear time without recursion and
give the same matches as their plain forms, which the tests compare.  Places
come from running sums, overlaps from running maxima, both by doubling steps
over an array, so that a text with n matches costs n log n.  What a function
inside an expression looks up by number is an array that the expression names
twice, so that the optimizer does not compute it anew for every element.

Defined results: a null or empty text has no spans, a very long one is searched
whole; spans are in code points, end exclusive; rows are judged by text alone,
so repeated rows get the same spans; of candidates that overlap with one
probability the earlier stays, then the kind listed first; an empty table gives
an empty table; columns ``base``, ``spans`` and ``redacted`` of the input are
replaced, all others stay.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm.boost import Boosted, boost, calibrated_threshold

KINDS = ("email", "ip", "card", "phone")
#: All kinds, those that only the method finds last.
ALL_KINDS = (*KINDS, "secret")
#: Base patterns by kind; what stands before a match start is looked at once.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without it has no match of that kind.
NEEDS = {"email": "@", "phone": "+"}
GENERATORS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+ ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]{1,63}+(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\})| dot |\.) ?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}([ ._/-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}|00[1-9](?:[ .-]?[0-9]){8,13})(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,200}+[0-9])(?=[0-9+/_-]{0,200}+[A-Za-z])[A-Za-z0-9+/_-]{16,200}+(?![A-Za-z0-9+/_-])={0,2}+",
}
#: More than the candidates that one candidate can overlap: none is longer than
#: 700 code points, and those of one kind share none.
NEAR = 600
#: Every text with a match of the generator has one of its hint.
_HINTS = {
    "email": r"[\[({]at[\])}]| at  ?[A-Za-z0-9-]+(?: ?[\[({]dot[\])}]| dot |\.) ?[A-Za-z0-9-]",
    "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:",
    "secret": r"[A-Za-z0-9+/_-]{16}",
}
CONTEXT = 24
TRAIN_ROWS = 2500
PRECISION = 0.97
FEATURES = (
    ("kind", "cast(x.k AS double)"),
    ("length", "cast(length(x.v) AS double)"),
    ("digits", "cast(length(regexp_replace(x.v, '[^0-9]', '')) AS double)"),
    ("marks", "cast(length(regexp_replace(x.v, '[A-Za-z0-9]', '')) AS double)"),
    ("spelled", "CASE WHEN x.v rlike '[(\\\\[{](at|dot)[)\\\\]}]' THEN 1D ELSE 0D END"),
    ("domain", "CASE WHEN x.v rlike '(?i)(com|net|org|edu|gov|info|io|de|fr|es)$' THEN 1D ELSE 0D END"),
    ("paren", "CASE WHEN x.v LIKE '(%' THEN 1D ELSE 0D END"),
    ("luhn", "CASE WHEN {luhn} THEN 1D ELSE 0D END"),
    ("cue", "CASE WHEN x.c rlike '(?i)(mail|contact|write|reach|phone|tel|call|fax|mobil|card|visa|pay|host|server|addr|kontakt|correo|courriel|carte|tarjeta)' THEN 1D ELSE 0D END"),
    ("number", "CASE WHEN x.c rlike '(?i)(order|invoice|ref|isbn|serial|part|version|page|ticket|case|bestell|factura|commande|commit|checksum|file|build)' THEN 1D ELSE 0D END"),
    ("secret_cue", "CASE WHEN x.c rlike '(?i)(token|secret|key|passw|pwd|auth|credential|bearer|login|senha|clave|schl)' THEN 1D ELSE 0D END"),
    ("prefix", "CASE WHEN x.v rlike '^(AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk-|eyJ|AIza)' THEN 1D ELSE 0D END"),
    ("hex", "CASE WHEN x.v rlike '^([0-9a-f]{16,}|[0-9A-F]{16,})$' THEN 1D ELSE 0D END"),
    ("switches", "cast(length(regexp_replace(x.v, '([0-9])[0-9]*|[^0-9]+', '$1')) AS double)"),
    ("mixed", "CASE WHEN x.v rlike '[A-Z]' AND x.v rlike '[a-z]' THEN 1D ELSE 0D END"),
    ("dialled", "CASE WHEN x.v rlike '^(\\\\([2-9][0-9]{2}\\\\) ?[2-9][0-9]{2}-|[2-9][0-9]{2}([ .-])[2-9][0-9]{2}\\\\2|00[1-9])' THEN 1D ELSE 0D END"),
)


def _luhn(value: str) -> str:
    """SQL: the digits of ``value`` pass the Luhn test."""
    d = f"regexp_replace({value}, '[^0-9]', '')"
    digit = f"int(substring({d}, -i, 1))"
    return (
        f"(length({d}) > 0 AND aggregate(sequence(1, greatest(1, length({d}))), 0, (a, i) -> "
        f"a + CASE WHEN i % 2 = 0 THEN 2 * {digit} - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END ELSE {digit} END) % 10 = 0)"
    )


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _scan(values: str, op: str, back: bool = False) -> str:
    """SQL: running ``op`` (a function of two numbers) over an array, from its
    beginning or ``back`` from its end, in doubling steps."""
    far = "i + shiftleft(1, j)" if back else "i - shiftleft(1, j)"
    inside = f"{far} < size(a)" if back else f"{far} >= 0"
    plus = "x + a[{0}]" if op == "+" else f"{op}(x, a[{{0}}])"
    return (
        f"CASE WHEN size({values}) > 1 THEN aggregate(sequence(0, int(ceil(log2(size({values})))) - 1), {values}, "
        f"(a, j) -> transform(a, (x, i) -> CASE WHEN {inside} THEN {plus.format(far)} ELSE x END)) ELSE {values} END"
    )


_SPAN = "array<struct<k:int,s:int,e:int,v:string,c:string>>"
_T, _M, _P, _E = "__pii_text", "__pii_m", "__pii_p", "__pii_e"


def _located(df: DataFrame, name: str, kind: str, pattern: str, when: Column | None) -> DataFrame:
    """Add ``name``: all matches of ``pattern`` with their places and what
    stands before them, back to the match before the last."""
    found = F.regexp_extract_all(_T, F.lit(pattern), F.lit(0))
    found = found if when is None else F.when(when, found)
    df = df.withColumn(_M, found)
    df = df.withColumn(_P, F.expr(f"CASE WHEN size({_M}) > 0 THEN split({_T}, {_quote(pattern)}, -1) END"))
    df = df.withColumn(_E, F.expr(f"transform({_M}, (v, i) -> length({_P}[i]) + length(v))"))
    df = df.withColumn(_E, F.expr(_scan(_E, "+")))
    before = f"substring(concat(CASE WHEN i > 0 THEN substring({_M}[i - 1], -{CONTEXT}) ELSE '' END, substring({_P}[i], -{CONTEXT})), -{CONTEXT})"
    made = f"transform({_M}, (v, i) -> named_struct('k', {ALL_KINDS.index(kind)}, 's', {_E}[i] - length(v), 'e', {_E}[i], 'v', v, 'c', {before}))"
    return df.withColumn(name, F.expr(f"CASE WHEN size({_M}) > 0 THEN {made} ELSE cast(array() AS {_SPAN}) END")).drop(_M, _P, _E)


def _tests() -> dict[str, str]:
    part = "trim(LEADING '0' FROM y)"
    return {
        "email": "true",
        "ip": f"forall(split(x.v, '[.]'), y -> CASE WHEN length({part}) > 3 THEN false ELSE int(concat('0', {part})) <= 255 END)",
        "card": _luhn("x.v"),
        "phone": "length(regexp_replace(x.v, '[^0-9]', '')) BETWEEN 10 AND 15",
    }


def _based(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the text, never null, and the base spans (k, s, e, v, c)
    in columns of the module's own."""
    df = docs.withColumn(_T, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    for kind in KINDS:
        when = F.contains(_T, F.lit(NEEDS[kind])) if kind in NEEDS else None
        df = _located(df, f"__pii_{kind}", kind, BASE[kind], when)
    parts = [F.expr(f"filter(__pii_{k}, x -> {test})") for k, test in _tests().items()]
    return df.withColumn("__pii_base", F.concat(*parts)).drop(*[f"__pii_{k}" for k in KINDS])


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base``, structs (s, k, e) by start."""
    df = _based(docs, text_col)
    return df.withColumn("base", F.sort_array(F.expr(_BARE.format("__pii_base")))).drop(_T, "__pii_base")


_BARE = "transform({}, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))"


def _samples(n: int = TRAIN_ROWS, seed: int = 11) -> list[tuple[int, str, str, int]]:
    """Synthetic spans (kind, text, words before, label) for training."""
    r = random.Random(seed)
    word = lambda a=3, b=9: "".join(r.choice("abcdefghilmnoprstuvw") for _ in range(r.randint(a, b)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    chars = lambda some, k: "".join(r.choice(some) for _ in range(k))
    cue = ("mail me: ", "contact ", "write to ", "call me ", "phone: ", "tel. ", "fax ", "my card is ", "reach us: ")
    number = ("order no. ", "invoice ", "ref ", "ISBN ", "serial ", "part ", "page ", "ticket ")
    plain = lambda: f"{word()} {word()} "
    out = []
    for i in range(n):
        k, yes = i % 5, r.random() < 0.5
        before = r.choice(cue) if yes and r.random() < 0.5 else r.choice(number) if not yes and r.random() < 0.5 else plain()
        if k == 0:
            at, dot = r.choice(((" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "."), (" at ", " dot ")))
            if yes:
                v = f"{word()}{r.choice(('.', '_', ''))}{word()}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr', 'es'))}"
            else:
                v = r.choice((f"{word()} at {word()}.{word(2, 8)}", f"{word()} at {word()} dot {word()}", f"{word()}(at){word()}.{word(5, 9)}", f"{word()} at {word()}. {word(2, 8)}"))
        elif k == 1:
            v = ":".join(f"{r.randrange(1 << 16):x}" for _ in range(8)) if yes else ":".join(digits(2) for _ in range(8))
        elif k == 2:
            sep = r.choice("./_ -") if yes else r.choice(" ._/-")
            d = digits(15)
            total = sum((x * 2 - 9 if x > 4 else x * 2) if j % 2 == 0 else x for j, x in enumerate(map(int, reversed(d))))
            last = (10 - total % 10) % 10
            d += str(last if yes else (last + r.randint(1, 9)) % 10)
            v = sep.join(d[j : j + 4] for j in range(0, 16, 4))
        elif k == 3:
            # real ones have codes from 200 on, unless a cue says so, and one kind of separator
            real = (yes and before not in cue) or r.random() < 0.5
            a, b = (r.choice("23456789" if real else "01") + digits(2) for _ in range(2))
            one = r.choice(" .-")
            two = one if yes or not real else r.choice([x for x in " .-" if x != one])
            v = r.choice((f"{a}{one}{b}{two}{digits(4)}", f"({a}) {b}-{digits(4)}", f"00{r.randint(1, 9)}{digits(1)} {digits(3)} {digits(6)}")[: 3 if yes else 1 if real else 2])
        else:
            letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
            if yes:
                v, named = r.choice(
                    (
                        (chars("0123456789abcdef", r.choice((32, 40, 64))), True), (chars(letters, r.randint(20, 64)), True), (chars(letters + "+/", r.randint(24, 88)) + "=" * r.randint(0, 2), True),
                        ("AKIA" + chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), False), ("ghp_" + chars(letters, 36), False), ("sk-" + chars(letters, 40), False), ("eyJ" + chars(letters + "_-", 90), False),
                    )
                )
                said = r.choice(("token = \"", "api_key=", "secret: ", "password: ", "Authorization: Bearer ", "access key ", "auth_token: '"))
                before = said if named or r.random() < 0.5 else plain()
            else:
                v = r.choice((f"{word()}-{word()}-{digits(r.randint(1, 4))}-{word()}", f"{word()}_{digits(4)}_{word()}_{digits(2)}", f"{word()}/{word()}/{word()}{digits(2)}/{word(2, 9)}", f"20{digits(2)}-{digits(2)}-{digits(2)}-{word()}-{word()}", word(14, 22) + digits(r.randint(1, 4)), chars("0123456789abcdef", 40)))
                before = r.choice(("commit ", "checksum ", "file ", "build ")) if len(v) == 40 else before
        out.append((k, v, before[-CONTEXT:], int(yes)))
    return out


def _features() -> list[str]:
    return [e.replace("{luhn}", _luhn("x.v")) for _, e in FEATURES]


_fitted: tuple[str, tuple[float, ...]] | None = None


def fitted(spark: SparkSession) -> tuple[str, tuple[float, ...]]:
    """SQL of the probability of features ``x.f``, and a threshold per kind."""
    global _fitted
    if _fitted is None:
        values = ", ".join(f"({k}, {_quote(v)}, {_quote(c)}, {y})" for k, v, c, y in _samples())
        rows = spark.sql(f"SELECT named_struct('k', k, 'v', v, 'c', c) AS x, y FROM VALUES {values} AS t(k, v, c, y)")
        got = rows.select(F.array(*map(F.expr, _features())).alias("f"), "y").collect()
        x, y = np.array([r["f"] for r in got]), np.array([r["y"] for r in got], float)
        held = np.arange(len(y)) // len(ALL_KINDS) % 3 == 2
        model: Boosted = boost(x[~held], y[~held])
        p = model.probability(x[held])
        cuts = [max(0.5, calibrated_threshold(p[x[held][:, 0] == k], y[held][x[held][:, 0] == k], PRECISION)) for k in range(len(ALL_KINDS))]
        _fitted = model.sql([f"x.f[{i}]" for i in range(len(FEATURES))]), tuple(cuts)
    return _fitted


def _spanned(docs: DataFrame, text_col: str) -> DataFrame:
    """``_based`` with ``__pii_spans``: base and selected spans (s, k, e)."""
    score, cuts = fitted(docs.sparkSession)
    df = _based(docs, text_col)
    for kind in ALL_KINDS:
        when = F.col(_T).rlike(_HINTS[kind]) if kind in _HINTS else None
        df = _located(df, f"__pii_more_{kind}", kind, GENERATORS[kind], when)
    more = [f"__pii_more_{k}" for k in ALL_KINDS]
    df = df.withColumn("__pii_more", F.concat(*map(F.col, more))).drop(*more)
    # a candidate overlaps a base span if of those that begin before its end one ends after its beginning
    ends = "transform(__pii_base, x -> named_struct('at', x.s, 'mine', 1, 's', 0, 'e', x.e, 'i', -1))"
    mine = "transform(__pii_more, (x, i) -> named_struct('at', x.e, 'mine', 0, 's', x.s, 'e', -1, 'i', i))"
    df = df.withColumn("__pii_both", F.expr(f"CASE WHEN size(__pii_more) > 0 THEN sort_array(concat({ends}, {mine})) END"))
    df = df.withColumn("__pii_far", F.expr("transform(__pii_both, x -> x.e)")).withColumn("__pii_far", F.expr(_scan("__pii_far", "greatest")))
    free = "filter(zip_with(__pii_both, __pii_far, (x, f) -> CASE WHEN x.mine = 0 AND f <= x.s THEN x.i ELSE -1 END), i -> i >= 0)"
    df = df.withColumn("__pii_more", F.expr(f"CASE WHEN size(__pii_more) > 0 THEN transform({free}, i -> __pii_more[i]) END"))
    cut = "element_at(array({}), x.k + 1)".format(", ".join(f"{c!r}D" for c in cuts))
    seen = f"transform(__pii_more, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'f', array({', '.join(_features())})))"
    df = df.withColumn("__pii_more", F.expr(seen))
    scored = f"filter(transform(__pii_more, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'p', {score})), x -> x.p >= {cut})"
    df = df.withColumn("__pii_more", F.expr(f"sort_array({scored})"))
    # of candidates that overlap, the likelier one stays; they are looked for among those joined by overlaps
    own = "'s', x.s, 'k', x.k, 'e', x.e, 'p', x.p"
    df = df.withColumn("__pii_far", F.expr("transform(__pii_more, x -> x.e)")).withColumn("__pii_far", F.expr(_scan("__pii_far", "greatest")))
    df = df.withColumn("__pii_more", F.expr(f"zip_with(__pii_more, __pii_far, (x, f) -> named_struct({own}, 'far', f))"))
    df = df.withColumn("__pii_more", F.expr(f"transform(__pii_more, (x, i) -> named_struct({own}, 'new', CASE WHEN i = 0 THEN true ELSE __pii_more[i - 1].far <= x.s END))"))
    df = df.withColumn("__pii_lo", F.expr("transform(__pii_more, (x, i) -> CASE WHEN x.new THEN i ELSE 0 END)")).withColumn("__pii_lo", F.expr(_scan("__pii_lo", "greatest")))
    last = "CASE WHEN i = size(__pii_more) - 1 THEN i WHEN __pii_more[i + 1].new THEN i ELSE size(__pii_more) END"
    df = df.withColumn("__pii_hi", F.expr(f"transform(__pii_more, (x, i) -> {last})")).withColumn("__pii_hi", F.expr(_scan("__pii_hi", "least", back=True)))
    df = df.withColumn("__pii_lo", F.expr("zip_with(__pii_lo, __pii_hi, (lo, hi) -> named_struct('lo', lo, 'hi', hi))"))
    df = df.withColumn("__pii_more", F.expr(f"zip_with(__pii_more, __pii_lo, (x, y) -> named_struct({own}, 'lo', y.lo, 'hi', y.hi))"))
    lo, hi = f"greatest(x.lo, i - {NEAR})", f"least(x.hi, i + {NEAR})"
    better = "y.s < x.e AND x.s < y.e AND (y.p > x.p OR (y.p = x.p AND (y.s < x.s OR (y.s = x.s AND y.k < x.k))))"
    beaten = f"exists(slice(__pii_more, {lo} + 1, {hi} - {lo} + 1), y -> {better})"
    picked = f"transform(filter(__pii_more, (x, i) -> NOT {beaten}), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))"
    both = f"CASE WHEN size(__pii_more) > 0 THEN concat({_BARE.format('__pii_base')}, {picked}) ELSE {_BARE.format('__pii_base')} END"
    df = df.withColumn("__pii_spans", F.sort_array(F.expr(both)))
    return df.drop("__pii_more", "__pii_both", "__pii_far", "__pii_lo", "__pii_hi")


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``, structs (s, k, e) by start: the
    base spans, and these with the selected candidates."""
    df = _spanned(docs, text_col).withColumn("base", F.sort_array(F.expr(_BARE.format("__pii_base"))))
    return df.withColumn("spans", F.col("__pii_spans")).drop(_T, "__pii_base", "__pii_spans")


def listed(spans: Column) -> Column:
    """Spans (s, k, e) as kind:start:end, joined by commas."""
    names = F.array(*map(F.lit, ALL_KINDS))
    one = lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``redacted``, the text in which every span, or the first of
    spans that overlap, became its kind in brackets."""
    df = _spanned(docs, text_col)
    names = "array({})".format(", ".join(f"'[{k}]'" for k in ALL_KINDS))
    df = df.withColumn("__pii_far", F.expr("transform(__pii_spans, x -> x.e)")).withColumn("__pii_far", F.expr(_scan("__pii_far", "greatest")))
    df = df.withColumn("__pii_chars", F.expr(f"CASE WHEN size(__pii_spans) > 0 THEN split({_T}, '') END"))
    upto = "CASE WHEN i > 0 THEN __pii_far[i - 1] ELSE 0 END"
    part = f"CASE WHEN x.s < {upto} THEN '' ELSE concat(array_join(slice(__pii_chars, {upto} + 1, x.s - {upto}), ''), element_at({names}, x.k + 1)) END"
    rest = "array_join(slice(__pii_chars, __pii_far[size(__pii_far) - 1] + 1, size(__pii_chars)), '')"
    out = F.expr(f"CASE WHEN size(__pii_spans) > 0 THEN concat(array_join(transform(__pii_spans, (x, i) -> {part}), ''), {rest}) ELSE {_T} END")
    return df.withColumn("redacted", out).drop(_T, "__pii_base", "__pii_spans", "__pii_far", "__pii_chars")
