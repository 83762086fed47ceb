"""Personal data by fixed forms, and by bootstrapped contextual extraction of what has other forms.

Base spans: e-mail addresses, IPv4 addresses, card numbers that pass Luhn's test and international phone numbers.
They are the seeds. Tokens with a digit or @ are instances, neighbouring ones without letters together one ("743 555
9999"); the word before and the word after an instance, whole, with digits folded, are patterns. Patterns and
instances form a graph: a pattern's score for a kind is the mean confidence of its distinct instances, an instance's
confidence is the noisy-or of the scores of its other patterns, and seeds stay certain. A pattern needs so many distinct
instances that are seeds or, from the second round on, that other patterns are confident of; so what is found induces
patterns that no seed stands in. After a few rounds, instances without a base span that stand in an accepted pattern
are added to the spans.

Everything is DataFrame functions. Null and empty texts have no spans; texts of any length are searched whole, in
linear time. Copies of a text count once in the graph, as its distinct instances do. Repeated rows keep their own
spans. Further columns are carried along by mark(); an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quoin.llm.common import looked_up, stored

KINDS = ("email", "ip", "card", "phone")

#: The base forms, so written that Java neither recurses nor scans a run of characters again from inside it; \G lets
#: a match begin where the one before ended. Cards: whole runs of 16 to 19 digits only, as others fail anyway.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GUARDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_NUMBER = r"[^\sA-Za-z0-9@]*+[0-9][^\sA-Za-z@]*+(?!\S)"
TOKEN = rf"(?<!\S)(?:{_NUMBER}(?:\x20{_NUMBER})*+|[^\s0-9@]*+[0-9@]\S*+)"

#: A pattern is accepted for a kind from this score on, with so many distinct instances of that confidence; rounds of scoring.
SCORE, SEEDS, ROUNDS = 0.75, 8, 4
#: Digits of an added instance that has no @: no identifier of the base kinds has more.
DIGITS, MOST_DIGITS = 6, 19

_SPAN = "array<struct<start:int,end:int,value:string>>"


def _located(matches: str, pieces: str) -> Column:
    """Matches with their code point positions, from the pieces between them."""
    return F.expr(f"""aggregate(
        filter(zip_with({matches}, {pieces}, (m, p) -> named_struct('m', m, 'p', p)), z -> z.m is not null),
        named_struct('at', 0, 'out', cast(array() as {_SPAN})),
        (a, z) -> named_struct(
            'at', a.at + char_length(z.p) + char_length(z.m),
            'out', concat(a.out, array(named_struct('start', a.at + char_length(z.p), 'end', a.at + char_length(z.p) + char_length(z.m), 'value', z.m)))),
        a -> a.out)""")


def _luhn(digits: str) -> str:
    """SQL: the sum with every second digit from the right doubled and cast out of nines is a multiple of ten."""
    doubled = f"cast(substring({digits}, -i, 1) as int) * if(i % 2 = 0, 2, 1)"
    return f"aggregate(sequence(1, char_length({digits})), 0, (a, i) -> a + cast(({doubled}) div 10 as int) + ({doubled}) % 10) % 10 = 0"


_HOLDS = {
    "email": "true",
    "ip": "forall(split(x.value, '[.]'), p -> coalesce(try_cast(p as int) <= 255, false))",
    "card": _luhn("translate(x.value, ' -', '')"),
    "phone": "char_length(translate(x.value, '+ ().-', '')) between 8 and 15",
}


def marked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with base array<struct<kind int, start, end>> (by kind, then start) and seen, its instances in their contexts."""
    has_digit = F.col("_digit")
    out = docs.withColumn("_digit", F.coalesce(F.col(text).rlike("[0-9]"), F.lit(False))).withColumn("_at", F.coalesce(F.col(text).contains("@"), F.lit(False)))
    searched = {**FORMS, "token": TOKEN}
    none = F.array().cast("array<string>")
    for kind, form in searched.items():
        mark = GUARDS.get(kind)
        may = {"email": F.col("_at"), "token": has_digit | F.col("_at")}.get(kind, has_digit if mark is None else has_digit & F.col(text).contains(mark))
        out = out.withColumn(f"_m_{kind}", F.when(may, F.regexp_extract_all(F.col(text), F.lit(form), F.lit(0))).otherwise(none))
    for kind, form in searched.items():
        out = out.withColumn(f"_p_{kind}", F.when(F.size(f"_m_{kind}") > 0, F.split(F.col(text), form, -1)).otherwise(none))
    for kind in searched:
        out = out.withColumn(f"_s_{kind}", F.when(F.size(f"_m_{kind}") > 0, _located(f"_m_{kind}", f"_p_{kind}")).otherwise(F.array().cast(_SPAN)))
    base = F.concat(*(F.expr(f"transform(filter(_s_{kind}, x -> {_HOLDS[kind]}), x -> named_struct('kind', {i}, 'start', x.start, 'end', x.end))") for i, kind in enumerate(KINDS)))
    out = out.withColumn("base", base)
    # an opening bracket stays where its closing one is inside
    cut = F.expr(r"""transform(_s_token, x -> named_struct('start', x.start, 'value', regexp_replace(x.value, '[^0-9A-Za-z]++$', '')))""")
    led = F.expr(r"""transform(_cut, x -> named_struct('start', x.start, 'value', x.value, 'lead', char_length(regexp_extract(x.value, if(contains(x.value, ')'), '^[^0-9A-Za-z+@(]*', '^[^0-9A-Za-z+@]*'), 0))))""")
    seen = F.expr(r"""transform(_led, (x, i) -> named_struct(
        'start', x.start + x.lead, 'end', x.start + char_length(x.value), 'value', substring(x.value, x.lead + 1),
        'before', substring_index(rtrim(translate(_p_token[i], '\t\n\r\f\u000b', '     ')), ' ', -1),
        'after', substring_index(ltrim(translate(_p_token[i + 1], '\t\n\r\f\u000b', '     ')), ' ', 1)))""")
    joined = F.expr(r"""transform(_seen, (x, i) -> named_struct('start', x.start, 'end', x.end, 'value', x.value,
        'before', regexp_replace(lower(if(x.before = '' and i > 0, _s_token[i - 1].value, x.before)), '[0-9]+', '9'),
        'after', regexp_replace(lower(if(x.after = '' and i + 1 < size(_s_token), _s_token[i + 1].value, x.after)), '[0-9]+', '9'),
        'kind', get(filter(base, b -> b.start < x.end and b.end > x.start).kind, 0)))""")
    out = out.withColumn("_cut", cut).withColumn("_led", led).withColumn("_seen", seen).withColumn("seen", joined)
    return out.select(*docs.columns, "base", "seen")


def _occurrences(rows: DataFrame) -> DataFrame:
    """(row, start, end, value, kind, pattern) of each instance and each of its two patterns."""
    one = rows.select("row", F.explode("seen").alias("x")).select("row", "x.*").filter("value <> ''")
    both = F.array(F.concat(F.lit("< "), "before"), F.concat(F.lit("> "), "after"))
    return one.select("row", "start", "end", "value", "kind", F.explode(both).alias("pattern")).filter("length(pattern) > 2")


def patterns(rows: DataFrame) -> DataFrame:
    """(pattern, kind, score): the accepted patterns, from the graph of all rows."""
    known = [F.max((F.col("kind") == i).cast("int")) for i in range(len(KINDS))]
    edges = stored(_occurrences(rows).groupBy("pattern", "value").agg(*(F.coalesce(k, F.lit(0)).cast("double").alias(f"k{i}") for i, k in enumerate(known))), "graph")
    now = edges.select("pattern", "value", *(F.col(f"k{i}").alias(f"s{i}") for i in range(len(KINDS))))
    seed = reduce(F.greatest, [F.col(f"k{i}") for i in range(len(KINDS))])
    for _ in range(ROUNDS):
        sums = [x for i in range(len(KINDS)) for x in (F.avg(f"s{i}").alias(f"p{i}"), F.sum((F.col(f"s{i}") >= SCORE).cast("int")).alias(f"n{i}"))]
        scores = now.groupBy("pattern").agg(*sums)
        scores = scores.select("pattern", *(F.when(F.col(f"n{i}") >= SEEDS, F.col(f"p{i}")).otherwise(0.0).alias(f"p{i}") for i in range(len(KINDS))))
        scores = stored(scores.filter(reduce(lambda a, b: a | b, (F.col(f"p{i}") > 0 for i in range(len(KINDS))))), "patterns")
        # of what its patterns say of an instance, each pattern is told what the others say; seeds stay what they are
        doubts = [F.log(F.greatest(F.lit(1e-9), 1 - F.coalesce(F.col(f"p{i}"), F.lit(0.0)) * 0.999)).alias(f"d{i}") for i in range(len(KINDS))]
        met = stored(looked_up(edges, scores, ["pattern"], "left").select("pattern", "value", *(f"k{i}" for i in range(len(KINDS))), *doubts), "met")
        told = met.groupBy("value").agg(*(F.sum(f"d{i}").alias(f"all{i}") for i in range(len(KINDS))))
        now = looked_up(met, told, ["value"]).select("pattern", "value", *(F.when(seed > 0, F.col(f"k{i}")).otherwise(1 - F.exp(F.col(f"all{i}") - F.col(f"d{i}"))).alias(f"s{i}") for i in range(len(KINDS))))
    kinds = F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(f"p{i}").alias("score")) for i in range(len(KINDS))))).alias("x")
    return scores.select("pattern", kinds).select("pattern", "x.kind", "x.score").filter(F.col("score") >= SCORE)


def found(docs: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with base and spans: base and added spans, array<struct<kind int, start, end>> by kind, then start."""
    rows = marked(docs.withColumn("row", F.monotonically_increasing_id()), text)
    rows = stored(rows if keep_text else rows.drop(text), "marked")
    new = _occurrences(rows).filter("kind is null").filter(F.length(F.regexp_replace("value", "[^0-9]", "")).between(DIGITS, MOST_DIGITS) | F.col("value").contains("@"))
    best = new.join(patterns(rows).withColumnRenamed("kind", "told"), "pattern").groupBy("row", "start", "end").agg(F.max(F.struct("score", (-F.col("told")).alias("t"))).alias("x"))
    added = best.groupBy("row").agg(F.collect_list(F.struct((-F.col("x.t")).alias("kind"), "start", "end")).alias("added"))
    joined = rows.join(added, "row", "left")
    return joined.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,end:int>>"))))).drop("seen", "added", "row")


def listed(spans: str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(array({names})[x.kind], ':', x.start, ':', x.end)), ',')")


def redacted(text: str = "text", spans: str = "spans") -> Column:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first stands."""
    names = ", ".join(f"'<{k.upper()}>'" for k in KINDS)
    return F.expr(f"""case when size({spans}) = 0 then {text} else aggregate(
        array_sort({spans}, (a, b) -> case when a.start < b.start then -1 when a.start > b.start then 1 when a.end > b.end then -1 when a.end < b.end then 1 else 0 end),
        named_struct('at', 0, 'out', ''),
        (a, x) -> if(x.start < a.at, named_struct('at', greatest(a.at, x.end), 'out', a.out), named_struct('at', x.end, 'out', concat(a.out, substring({text}, a.at + 1, x.start - a.at), array({names})[x.kind]))),
        a -> concat(a.out, substring({text}, a.at + 1))) end""")
