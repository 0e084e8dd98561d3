"""Personal data: rule spans, and further spans that boosted trees select among candidates. Scoring is SQL expressions only.

The base spans of a kind are the matches of its pattern, leftmost and not overlapping, that pass its check. Their places
come from the lengths of the matches and of the stretches between them. Two generators of high recall propose further
candidates: stretches with an at sign or its spelling, and, in every stretch of digits with few signs between them, all runs of one
to six neighbouring groups of digits that have 7 to 19 digits, so these overlap each other. From each candidate's form and the text next to it come
features; the boosted trees of a kind give a calibrated probability, and from a threshold on, fitted for precision, it may be a
span of that kind. Candidates that overlap a base span go; of those that overlap each other the most probable is taken (then the
longer, then the earlier one), and those it displaced that overlap nothing taken are compared once more.

The trees are fitted on the driver on ``examples`` made from seeded formats, lists of numbers among them, as the corpus has no labels for spans.

Null and empty texts have no spans. Rows that repeat get the same result. Columns of the results replace columns of the
same name, others pass through. Places are code points, ends exclusive.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.llm import boosting
from regspark.llm.common import numbered

KINDS = ["email", "ip", "card", "phone"]

# The base patterns, in a form that looks at no character twice. A match can only begin where the stretch of
# its first class begins or where the match before it ended (\G); possessive repeats give the same matches as greedy ones.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
MAIL_LIKE = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?|\x20(?:at|AT)\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?|\x20(?:dot|DOT)\x20)[A-Za-z0-9-]++)++"
NUMBER_LIKE = r"[+(]?[0-9](?:[\x20().\-/]{0,3}[0-9])++"


def _prefix_sums(a: str, block: int = 128) -> str:
    """Array of the sums before each element; in blocks, so that long arrays stay cheap."""
    run = "aggregate({0}, named_struct('s', 0L, 'o', cast(array() as array<bigint>)), (m, v) -> named_struct('s', m.s + v, 'o', concat(m.o, array(m.s))), m -> m.o)"
    blocks = f"transform(sequence(0, greatest(size({a}) - 1, 0) div {block}), b -> slice({a}, b * {block} + 1, {block}))"
    totals = f"transform({blocks}, w -> aggregate(w, 0L, (m, v) -> m + v))"
    return f"flatten(zip_with(transform({blocks}, w -> {run.format('w')}), {run.format(totals)}, (o, base) -> transform(o, v -> v + base)))"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    d = f"cast(substring(lpad({digits}, 20, '0'), i, 1) as int)"
    return f"(aggregate(sequence(1, 20), 0, (a, i) -> a + if(i % 2 = 1, {d} * 2 - if({d} > 4, 9, 0), {d})) % 10 = 0)"


CHECKS = {
    "email": "true",
    "ip": f"x.m rlike '^({_OCTET}[.]){{3}}{_OCTET}$'",
    "card": f"length({_digits('x.m')}) between 13 and 19 and {_luhn(_digits('x.m'))}",
    "phone": f"length({_digits('x.m')}) between 9 and 15",
}

FEATURES = {
    "digits": f"length({_digits('x.m')})",
    "width": "length(x.m)",
    "groups": "size(filter(split(x.m, '[^0-9]+'), g -> g <> ''))",
    "longest": "array_max(transform(split(x.m, '[^0-9]+'), g -> length(g)))",
    "plus": "int(x.m like '+%')",
    "bracket": "int(x.m rlike '[()]')",
    "dots": "length(x.m) - length(replace(x.m, '.', ''))",
    "dashes": "length(x.m) - length(replace(x.m, '-', ''))",
    "slashes": "length(x.m) - length(replace(x.m, '/', ''))",
    "spaces": "length(x.m) - length(replace(x.m, ' ', ''))",
    "luhn": f"int(length({_digits('x.m')}) between 13 and 19 and {_luhn(_digits('x.m'))})",
    "national": "int(x.m rlike '^([+]?[0-9]{1,3}[ .-])?[(]?[0-9]{3}[)]?[ .-]?[0-9]{3}[ .-]?[0-9]{4}$')",
    "date": "int(x.m rlike '^([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})')",
    "fours": "int(x.m rlike '^[0-9]{4}([^0-9][0-9]{4}){2,3}')",
    "at": "int(x.m like '%@%')",
    "spelled": "int(lower(x.m) rlike '(at|dot)')",
    "marked": r"int(x.m rlike '[\\[(]')",
    "tld": "int(lower(x.m) rlike '(com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$')",
    "call": "int(lower(x.before) rlike '(^|[^a-z])(tel|phone|call|fax|mobile|cell|ring|whatsapp|sms|dial)')",
    "pay": "int(lower(x.before) rlike '(^|[^a-z])(card|visa|master|amex|credit|debit|iban|payment)')",
    "mail": "int(lower(x.before) rlike '(^|[^a-z])(mail|contact|write|reach|send)')",
    "other": "int(lower(x.before) rlike '(^|[^a-z])(isbn|order|invoice|version|serial|ticket|date|sku|total|price|no[.]|number of|page|id)')",
    "date_before": r"int(x.before rlike '((19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|([0-9]{1,3}[.]){3}[0-9]{1,3})[^0-9]{1,4}$')",
    "date_after": r"int(x.after rlike '^[^0-9]{1,4}((19|20)[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|([0-9]{1,3}[.]){3}[0-9]{1,3})')",
    "phone_before": r"int(x.before rlike '[0-9]{3}[)]?[ .-]?[0-9]{3}[ .-]?[0-9]{4}[^0-9]{1,4}$')",
    "phone_after": r"int(x.after rlike '^[^0-9]{1,4}[0-9]{3}[)]?[ .-]?[0-9]{3}[ .-]?[0-9]{4}([^0-9]|$)')",
    "card_before": r"int(x.before rlike '[0-9]{4}[^0-9][0-9]{4}[^0-9][0-9]{1,4}[^0-9]{1,4}$')",
    "card_after": r"int(x.after rlike '^[^0-9]{1,4}[0-9]{4}[^0-9][0-9]{4}[^0-9][0-9]{4}')",
    "first": "coalesce(try_cast(left(regexp_replace(x.m, '[^0-9]', ''), 1) as int), -1)",
    "even": r"int(x.m rlike '^[(+]?[0-9]+([^0-9]{1,2})[0-9]+(\\1[0-9]+)*$')",
    "more_before": r"int(x.before rlike '[0-9][\\x20().\\-/]{1,3}[+(]?$')",
    "more_after": r"int(x.after rlike '^[\\x20().\\-/]{1,3}[0-9]')",
    "glued": "int(x.before rlike '[A-Za-z0-9_/.]$' or x.after rlike '^[A-Za-z0-9_/]')",
}
#: The kinds that candidates can get, with the generator that proposes them.
ADDED = {"email": MAIL_LIKE, "phone": NUMBER_LIKE, "card": NUMBER_LIKE}


GROUPS, LEAST_DIGITS, MOST_DIGITS = 6, 7, 19


def digit_runs(text: str) -> list[tuple[int, int]]:
    """The runs of digit groups that the SQL generator proposes for a text, by start, then end."""
    out = []
    for m in re.finditer(NUMBER_LIKE, text):
        groups = [g.span() for g in re.finditer("[0-9]+", text[m.start():m.end()])]
        for i, (s, _) in enumerate(groups):
            lead = s > 0 and m[0][s - 1] in "+("
            out += [(m.start() + s - lead, m.start() + e) for k, (_, e) in enumerate(groups[i:i + GROUPS]) if LEAST_DIGITS <= sum(y - x for x, y in groups[i:i + k + 1]) <= MOST_DIGITS]
    return out


def examples(n: int = 3000, seed: int = 11) -> list[tuple[str, str, str, str]]:
    """Labelled candidates: kind or 'none', candidate, text before, text after. Numbers stand alone or in lists, and all runs of their digit
    groups are candidates, of which those that are just one number have its kind."""
    rnd = random.Random(seed)
    num = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice("abcdefghilmnoprstuvw") for _ in range(rnd.randint(2, 8)))

    def card() -> str:
        d = rnd.choice("3456") + num(rnd.choice([12, 13, 14, 14, 14, 15, 17]))
        total = sum(v if i % 2 else (v * 2 - 9 if v > 4 else v * 2) for i, v in enumerate(map(int, reversed(d))))
        d += str(-total % 10)
        s = rnd.choice(["", " ", "-", ".", "/"])
        return s.join(d[i:i + 4] for i in range(0, len(d), 4)) if s else d

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rnd.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"0{num(2)} {num(3)} {num(4)}", f"0{num(3)}/{num(6)}", f"+{num(2)} {a} {b} {c}", f"{num(10)}"])

    def mail() -> str:
        at, dot = rnd.choice([(" at ", " dot "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("[at]", "."), ("@", ".")])
        return f"{word()}{at}{word()}{dot}{rnd.choice(['com', 'org', 'net', 'de', 'fr', 'io'])}"

    def other() -> str:
        return rnd.choice([
            f"20{num(2)}-0{rnd.randint(1, 9)}-1{rnd.randint(0, 9)}", f"1{num(1)}/0{rnd.randint(1, 9)}/19{num(2)}", f"{num(1)}.{num(2)}.{num(4)}", num(rnd.randint(7, 9)), num(rnd.randint(11, 24)),
            f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(3)}.{num(9)}", f"{num(2)} {num(2)} {num(2)} {num(2)}", f"{num(5)}-{num(5)}", f"{num(4)}/{num(4)}", f"{num(3)} {num(3)} {num(3)}",
            f"{num(4)}-{num(4)}-{num(4)}-{num(4)}", f"{num(1)}-{num(1)}-{num(1)}-{num(1)}-{num(1)}-{num(1)}-{num(1)}", f"{word()} at {word()} dot {word()}", f"{word()}@{word()}", f"{word()} at {word()}.{word()}"])

    hint = {"phone": ["call ", "tel: ", "phone ", "fax ", "mobile: ", "please ring "], "card": ["card ", "visa ", "credit card: ", "paid with card no "],
            "email": ["mail ", "contact: ", "write to ", "reach me via "], "none": ["order ", "isbn ", "version ", "serial ", "invoice ", "total ", "date ", "id "]}
    out = []
    for _ in range(n):
        kind = rnd.choice(["phone", "card", "email", "none", "none", "none"])
        make = {"phone": phone, "card": card, "email": mail, "none": other}[kind]
        before = rnd.choice(hint[kind]) if rnd.random() < 0.6 else f"{word()} {word()} "
        after = rnd.choice([" ", ".", ",", ""]) + word() if rnd.random() < 0.9 else ""
        if rnd.random() < 0.08 and kind == "none":
            before, after = word(), word()
        items = [make() for _ in range(1 if kind == "email" or rnd.random() < 0.6 else rnd.randint(2, 4))]
        if kind != "email" and rnd.random() < 0.35:  # a date or an address beside the number
            items.insert(rnd.randrange(len(items) + 1), rnd.choice([f"20{num(2)}-0{rnd.randint(1, 9)}-1{rnd.randint(0, 9)}", f"10.{rnd.randint(0, 99)}.{rnd.randint(0, 99)}.{rnd.randint(1, 99)}"]))
        gap, text, own = rnd.choice([" ", " ", ", ", " / ", "; ", " or "]), before, set()
        for k, m in enumerate(items):
            text += gap if k else ""
            if kind != "none" and not re.fullmatch(r"20[0-9]{2}-0[0-9]-1[0-9]|10(\.[0-9]+){3}", m):
                own.add((len(text), len(text) + len(m)))
            text += m
        text += after
        if kind == "email":
            (s, e), = own
            out.append((kind, text[s:e], text[max(s - 24, 0):s], text[e:e + 24]))
            continue
        if "@" in text or " at " in text:
            s = len(before)
            out.append(("none", items[0], before[-24:], text[s + len(items[0]):][:24]))
        for s, e in digit_runs(text):
            alone = re.fullmatch("[0-9]{10}", text[s:e]) and before not in hint["phone"]  # ten digits are a phone number only if the text says so
            out.append((kind if (s, e) in own and not (kind == "phone" and alone) else "none", text[s:e], text[max(s - 24, 0):s], text[e:e + 24]))
    return out


@cache
def _models(seed: int = 11) -> dict[str, boosting.Boosted]:
    """One model a kind, from features that Spark computed on the examples."""
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    rows = spark.createDataFrame(examples(seed=seed), "kind string, m string, before string, after string")
    got = rows.select("kind", F.struct("m", "before", "after").alias("x")).select("kind", *[F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()]).collect()
    x = np.array([[float(v) for v in r[1:]] for r in got])
    return {k: boosting.fit(x, np.array([r[0] == k for r in got]), list(FEATURES), trees=40, depth=4, precision=0.98) for k in ADDED}


def _matches(text: Column, pattern: str) -> tuple[Column, Column]:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _placed(found: str, gaps: str) -> Column:
    """Matches with start, end and the text next to them."""
    starts = f"zip_with({_prefix_sums(f'transform({gaps}, g -> cast(length(g) as bigint))')}, {_prefix_sums(f'transform({found}, g -> cast(length(g) as bigint))')}, (a, b) -> a + b)"
    full = (f"transform({found}, (m, i) -> named_struct('m', m, 'start', st[i] + cast(length({gaps}[i]) as bigint), 'end', st[i] + cast(length({gaps}[i]) + length(m) as bigint), "
            f"'before', right({gaps}[i], 24), 'after', left({gaps}[i + 1], 24)))")
    return F.expr(f"if(size({found}) = 0, cast(array() as array<struct<m:string,start:bigint,end:bigint,before:string,after:string>>), "
                  f"element_at(transform(array({starts}), st -> {full}), 1))")


def _let(names: dict[str, str], variable: str, body: str) -> str:
    """SQL of ``body`` with ``variable.name`` for each value, which is computed once."""
    return f"element_at(transform(array(named_struct({', '.join(f"'{k}', {v}" for k, v in names.items())})), {variable} -> {body}), 1)"


def _number_runs(stretches: str) -> str:
    """SQL: candidates (m, start, end, before, after) in an array of placed stretches; the work is linear in their digit groups."""
    length = "transform({0}, y -> cast(length(y) as bigint))"
    upto = f"sequence(i, cast(least(i + {GROUPS - 1}, size(v.g) - 1) as int))"
    # the pieces before and behind a run: twelve groups are 24 characters
    head = "concat(if(i <= 12, x.before, ''), aggregate(filter(sequence(greatest(i - 12, 0), i), k -> k < i), '', (a, k) -> concat(a, v.s[k], v.g[k])), v.s[i])"
    tail = "concat(aggregate(filter(sequence(j, least(j + 12, size(v.g) - 1)), k -> k > j), '', (a, k) -> concat(a, v.s[k], v.g[k])), if(j + 12 >= size(v.g) - 1, concat(v.s[size(v.g)], x.after), ''))"
    own = "aggregate(filter(sequence(i, j), k -> k > i), concat(h.lead, v.g[i]), (a, k) -> concat(a, v.s[k], v.g[k]))"
    one = (f"named_struct('m', {own}, 'start', x.start + w.at[i] - length(h.lead), 'end', x.start + w.at[j] + length(v.g[j]), "
           f"'before', right(left(h.text, length(h.text) - length(h.lead)), 24), 'after', left({tail}, 24))")
    enough = f"w.digits[j] + length(v.g[j]) - w.digits[i] between {LEAST_DIGITS} and {MOST_DIGITS}"
    per_start = _let({"text": head, "lead": "if(right(v.s[i], 1) in ('+', '('), right(v.s[i], 1), '')"}, "h", f"transform(filter({upto}, j -> {enough}), j -> {one})")
    places = _let({"gaps": length.format("v.s"), "sizes": length.format("v.g")}, "z",
                  _let({"digits": _prefix_sums("z.sizes"), "before": _prefix_sums("z.gaps"), "gaps": "z.gaps"}, "u",
                       "named_struct('digits', u.digits, 'at', transform(u.digits, (d, i) -> d + u.before[i] + u.gaps[i]))"))
    per_stretch = _let({"g": "regexp_extract_all(x.m, '[0-9]+', 0)", "s": "split(x.m, '[0-9]+', -1)"}, "v",
                       f"element_at(transform(array({places}), w -> flatten(transform(sequence(0, size(v.g) - 1), i -> {per_start}))), 1)")
    return f"flatten(transform({stretches}, x -> {per_stretch}))"


#: So many neighbours in order of start hold all that can overlap a candidate.
_NEAR = GROUPS * GROUPS
_OVER = "(y.start < x.end and x.start < y.end)"
_BETTER = "(y.p > x.p or (y.p = x.p and (y.end - y.start > x.end - x.start or (y.end - y.start = x.end - x.start and y.start < x.start))))"


def _near(array: str) -> str:
    return f"slice({array}, greatest(i - {_NEAR}, 0) + 1, {2 * _NEAR + 1})"


def _taken(candidates: str) -> str:
    """SQL: of candidates (start, end, kind, p) in order of start those that stay, see the module's text."""
    marked = f"transform(c.all, (x, i) -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind, 'p', x.p, 'lost', exists({_near('c.all')}, y -> {_OVER} and {_BETTER})))"
    again = f"filter(k.all, (x, i) -> x.lost and not exists({_near('k.all')}, y -> not y.lost and {_OVER}))"
    second = f"filter(r.all, (x, i) -> not exists({_near('r.all')}, y -> {_OVER} and {_BETTER}))"
    body = _let({"all": marked}, "k", _let({"all": again}, "r", f"concat(filter(k.all, x -> not x.lost), {second})"))
    return _let({"all": candidates}, "c", body)


def find(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows with ``base`` and ``spans``: arrays of (kind, start, end) by kind as listed, then start, and ``n_email, n_ip, n_card, n_phone``
    of the base spans."""
    models = _models()
    made = ["base", "spans", *[f"n_{k}" for k in KINDS]]
    docs, of = numbered(docs.drop(*made))
    text = F.coalesce(F.col(of[text_col]), F.lit(""))
    sets = PATTERNS | {"mail_like": MAIL_LIKE, "number_like": NUMBER_LIKE}
    needs = {"email": text.contains("@"), "mail_like": text.rlike("@|[aA][tT]")}
    rows = docs.withColumn("_any", text.rlike("[0-9@]|[aA][tT][\\]) ]"))
    none = F.lit(None).cast("array<string>")
    rows = rows.withColumns({f"_m_{k}": F.when(F.col("_any") & needs.get(k, F.lit(True)), _matches(text, p)[0]).otherwise(F.coalesce(none, F.array().cast("array<string>"))) for k, p in sets.items()})
    rows = rows.withColumns({f"_g_{k}": F.when(F.size(f"_m_{k}") > 0, _matches(text, p)[1]) for k, p in sets.items()})
    rows = rows.withColumns({f"_p_{k}": _placed(f"_m_{k}", f"_g_{k}") for k in sets})
    span = lambda kind: f"x -> named_struct('kind', '{kind}', 'start', x.start, 'end', x.end)"
    rows = rows.withColumns({f"_b_{k}": F.expr(f"transform(filter(_p_{k}, x -> {CHECKS[k]}), {span(k)})") for k in KINDS})
    rows = rows.withColumn("base", F.concat(*[F.col(f"_b_{k}") for k in KINDS]))

    free = "not exists(base, s -> s.start < x.end and x.start < s.end)"
    features = "named_struct(" + ", ".join(f"'{k}', cast({e} as double)" for k, e in FEATURES.items()) + ")"
    proposed = {"mail_like": "_p_mail_like", "number_like": _number_runs(f"filter(_p_number_like, x -> length({_digits('x.m')}) >= {LEAST_DIGITS})")}
    rows = rows.withColumns({f"_r_{k}": F.expr(f"if(size(_p_{k}) = 0, _p_{k}, {e})") for k, e in proposed.items()})
    for source, kinds in (("mail_like", ["email"]), ("number_like", ["phone", "card"])):
        seen = f"transform(filter(_r_{source}, x -> {free}), x -> named_struct('start', x.start, 'end', x.end, 'f', {features}))"
        scored = ", ".join(f"'{k}', {models[k].sql('x.f')}" for k in kinds)
        rows = rows.withColumn(f"_c_{source}", F.expr(f"transform({seen}, x -> named_struct('start', x.start, 'end', x.end, {scored}))"))
    card, phone = (f"x.{k} >= {models[k].threshold}" for k in ("card", "phone"))
    rows = rows.withColumn("_a_email", F.expr(f"transform(filter(_c_mail_like, x -> x.email >= {models['email'].threshold}), {span('email')})"))
    # an address that a number candidate overlaps comes first
    clear = f"filter(_c_number_like, x -> ({card} or {phone}) and not exists(_a_email, s -> s.start < x.end and x.start < s.end))"
    passing = f"transform({clear}, x -> named_struct('start', x.start, 'end', x.end, 'kind', if({card}, 'card', 'phone'), 'p', if({card}, x.card, x.phone)))"
    rows = rows.withColumn("_t", F.expr(f"if(size(_c_number_like) = 0, cast(array() as array<struct<start:bigint,end:bigint,kind:string,p:double,lost:boolean>>), {_taken(passing)})"))
    more = {"email": "_a_email"} | {k: f"transform(filter(_t, x -> x.kind = '{k}'), {span(k)})" for k in ("card", "phone")}
    by_start = "(a, b) -> case when a.start < b.start then -1 when a.start > b.start then 1 else 0 end"
    spans = F.concat(*[F.expr(f"array_sort(concat(_b_{k}, {more[k]}), {by_start})") if k in more else F.col(f"_b_{k}") for k in KINDS])
    return rows.select(*[F.col(c).alias(name) for name, c in of.items()], "base", spans.alias("spans"), *[F.size(f"_b_{k}").cast("long").alias(f"n_{k}") for k in KINDS])


def joined(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def redacted(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The text with each span replaced by its kind in angle brackets, from the result of ``find``. Spans of different kinds that overlap are
    taken together under the kind of the first. Null text stays null."""
    ordered = "array_sort(transform(spans, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))"
    merged = (f"aggregate({ordered}, named_struct('at', 0L, 'out', ''), (m, s) -> if(s.start >= m.at, "
              f"named_struct('at', s.end, 'out', concat(m.out, substring({text_col}, cast(m.at + 1 as int), cast(s.start - m.at as int)), '<', s.kind, '>')), "
              f"named_struct('at', greatest(m.at, s.end), 'out', m.out)), m -> concat(m.out, substring({text_col}, cast(m.at + 1 as int))))")
    return found.withColumn(text_col, F.expr(f"if({text_col} is null, null, {merged})"))
