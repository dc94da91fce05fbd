"""Personal data by weak supervision, in DataFrame and SQL functions only.

Four fixed kinds (email, ip, card, phone) are found by pattern and check and always stay. Further
candidates (titled names, social security numbers, local telephone numbers, account and id numbers)
and the fixed matches, failing ones too, are judged by five labelers that vote yes, no or nothing:
the shape of the match, a gazetteer of its parts, the words before it, its checksum or ranges, and
its variety. Expectation-maximisation over the counts of vote patterns estimates how reliable each
labeler is and how often each kind is personal; the posteriors train a logistic span classifier,
which decides about the further candidates.

One pass over the texts leaves the candidates, without the texts, in the shared folder. Learning
reads counts of feature patterns, of which there is a fixed number whatever the input.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom import session

BASE = ("email", "ip", "card", "phone")
FURTHER = ("name", "ssn", "tel", "account", "number")
KINDS = (*BASE, *FURTHER)
LABELERS = ("shape", "gazetteer", "context", "check", "variety")
#: Code points before a match that are its context.
NEAR = 40

# Possessive, so that a long run can neither be given back nor deepen the matcher's stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "further": (
        r"(?<![\p{L}])(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señora?|Sra?)\.?\x20\p{Lu}\p{L}++(?:\x20\p{Lu}\p{L}++)?"
        r"|(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
        r"|(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
        r"|(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"
        r"|(?<![0-9.A-Za-z-])[0-9]{6,11}(?![0-9.A-Za-z-])"),
}
#: A cheap test without which a pattern cannot match.
GUARDS = {"email": "instr(text, '@') > 0", "ip": "text RLIKE '[0-9]'", "card": "text RLIKE '[0-9]'", "phone": "instr(text, '+') > 0", "further": "true"}

# Gazetteers and context words.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu", "ch", "at")
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "39", "41", "43", "44", "45", "46", "47", "48", "49", "52", "55", "61", "81", "86", "91")
GIVEN_NAMES = (
    "Anna", "Anne", "Carlos", "Charles", "David", "Elena", "Emma", "Hans", "James", "Jean", "Johann", "John", "Jose", "Julia", "Karl", "Laura",
    "Louis", "Luis", "Maria", "Marie", "Mark", "Martin", "Mary", "Michael", "Paul", "Peter", "Pierre", "Robert", "Sarah", "Sophie", "Thomas", "William")
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "22", "23", "24", "25", "26", "27")
ACCOUNT_COUNTRIES = ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
PERSONAL_WORDS = (
    "account", "address", "adresse", "anruf", "call", "card", "carte", "compte", "contact", "correo", "credit", "cuenta", "customer", "email",
    "e-mail", "fax", "iban", "ident", "kontakt", "konto", "kunde", "mail", "mobile", "name", "passport", "patient", "phone", "social security",
    "ssn", "tarjeta", "tel", "teléfono", "visa", "whatsapp")
OTHER_WORDS = ("version", "isbn", "issn", "page", "figure", "chapter", "invoice", "order", "build", "error", "line", "port", "copyright", "price", "$", "#")


def quoted(words: tuple[str, ...]) -> str:
    return "array(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def one_of(column: str, words: tuple[str, ...]) -> str:
    return f"exists({quoted(words)}, w -> instr({column}, w) > 0)"


def begins(column: str, words: tuple[str, ...]) -> str:
    return f"exists({quoted(words)}, w -> startswith({column}, w))"


def vote(yes: str, no: str = "false") -> str:
    return f"CASE WHEN {yes} THEN 1 WHEN {no} THEN -1 ELSE 0 END"


def with_matches(docs: DataFrame, kind: str) -> DataFrame:
    """Adds ``found_<kind>``: every match with its code point range and the text just before it.

    The text between matches gives their places: Java's split and find use one matcher, so gaps and
    matches alternate.
    """
    pattern = PATTERNS[kind]
    none = F.array().cast("array<string>")
    docs = docs.withColumn(f"m_{kind}", F.when(F.expr(GUARDS[kind]), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    docs = docs.withColumn(f"g_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern, -1)).otherwise(none))
    row = "array<struct<start:int,end:int,match:string,before:string>>"
    spans = F.expr(f"""
        IF(size(m_{kind}) = 0, cast(array() as {row}), aggregate(sequence(0, size(m_{kind}) - 1),
          named_struct('at', 0, 'out', cast(array() as {row})),
          (s, i) -> named_struct(
            'at', s.at + length(g_{kind}[i]) + length(m_{kind}[i]),
            'out', concat(s.out, array(named_struct(
                'start', s.at + length(g_{kind}[i]), 'end', s.at + length(g_{kind}[i]) + length(m_{kind}[i]),
                'match', m_{kind}[i], 'before', lower(right(g_{kind}[i], {NEAR})))))),
          s -> s.out))""")
    return docs.withColumn(f"found_{kind}", spans).drop(f"m_{kind}", f"g_{kind}")


LUHN = ("length(digits) > 0 AND aggregate(sequence(1, greatest(1, length(digits))), 0, (s, i) -> s + "
        "element_at(array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9), "
        "IF(i % 2 = 0, 11, 1) + CAST(substring(digits, -i, 1) AS INT))) % 10 = 0")


def with_digits(array: str) -> Column:
    """Each match with its digits beside it, so that the checks need them worked out once."""
    return F.expr(f"transform({array}, c -> named_struct('start', c.start, 'end', c.end, 'match', c.match, 'before', c.before, "
                  "'digits', regexp_replace(c.match, '[^0-9]', '')))")


def checks(kind: str) -> str:
    """SQL text over ``c``: whether a match of a fixed kind holds."""
    digits = "length(c.digits)"
    return {
        "email": "true",
        "ip": r"forall(split(c.match, '[.]'), p -> p RLIKE '^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$')",
        "card": f"{digits} BETWEEN 12 AND 19 AND {LUHN.replace('digits', 'c.digits')}",
        "phone": f"{digits} BETWEEN 9 AND 15",
    }[kind]


def further_kind() -> str:
    return (r"CASE WHEN c.match RLIKE '^[0-9]{3}-[0-9]{2}-[0-9]{4}$' THEN 'ssn' WHEN c.match RLIKE '^[0-9]{6,11}$' THEN 'number'"
            r" WHEN c.match RLIKE '^[A-Z]{2}[0-9]{2}[A-Z0-9]+$' THEN 'account' WHEN c.match RLIKE '^[(0-9]' THEN 'tel' ELSE 'name' END")


def votes() -> str:
    """SQL text over ``c`` (kind, match, digits, before, holds): the labelers' votes, in order."""
    part = "element_at(split(c.match, '[.@]'), -1)"
    shape = f"""CASE c.kind
        WHEN 'email' THEN {vote(f"{part} RLIKE '^[A-Za-z]{{2,24}}$'", "true")}
        WHEN 'ip' THEN {vote("c.match RLIKE '^(?:0|[1-9][0-9]*)(?:[.](?:0|[1-9][0-9]*)){3}$'", "true")}
        WHEN 'card' THEN {vote("length(c.digits) IN (13, 14, 15, 16, 19)", "true")}
        WHEN 'phone' THEN {vote("length(c.digits) BETWEEN 10 AND 13")}
        WHEN 'tel' THEN {vote("c.match RLIKE '^[(]?[2-9]'", "true")}
        WHEN 'ssn' THEN {vote("NOT c.match RLIKE '^(?:000|666|9)' AND NOT c.match RLIKE '-00-|-0000'", "true")}
        WHEN 'account' THEN {vote("length(c.match) BETWEEN 15 AND 34")}
        WHEN 'name' THEN {vote("size(split(c.match, ' ')) = 3")}
        ELSE 0 END"""
    gazetteer = f"""CASE c.kind
        WHEN 'email' THEN {vote(f"array_contains({quoted(DOMAINS)}, lower({part}))")}
        WHEN 'ip' THEN {vote("false", "c.match RLIKE '^(?:0|10|127|169[.]254|192[.]168|255)[.]'")}
        WHEN 'card' THEN {vote(begins("c.digits", ISSUERS), "true")}
        WHEN 'phone' THEN {vote(begins("c.digits", CALLING_CODES), "true")}
        WHEN 'account' THEN {vote(begins("c.match", ACCOUNT_COUNTRIES), "true")}
        WHEN 'name' THEN {vote(one_of("c.match", tuple(" " + n for n in GIVEN_NAMES)))}
        ELSE 0 END"""
    context = vote(one_of("c.before", PERSONAL_WORDS), one_of("c.before", OTHER_WORDS))
    check = "CASE WHEN c.kind IN ('email', 'ip', 'card', 'phone') THEN IF(c.holds, 1, -1) ELSE 0 END"
    variety = "CASE WHEN length(c.digits) >= 6 THEN IF(size(array_distinct(split(c.digits, ''))) >= 4, 1, -1) ELSE 0 END"
    return f"array({shape}, {gazetteer}, {context}, {check}, {variety})"


def candidates(docs: DataFrame, key: str) -> DataFrame:
    """``key``, ``base`` (the fixed kinds' spans that hold) and ``judged`` (all candidates with their votes)."""
    found = docs.select(F.col(key), F.coalesce("text", F.lit("")).alias("text"))
    for kind in (*BASE, "further"):
        found = with_matches(found, kind)
    found = found.drop("text").withColumns({f"found_{k}": with_digits(f"found_{k}") for k in (*BASE, "further")})
    each = [f"transform(found_{k}, c -> named_struct('kind', '{k}', 'start', c.start, 'end', c.end, 'match', c.match, 'before', c.before, "
            f"'digits', c.digits, 'holds', {checks(k)}))" for k in BASE]
    found = found.withColumn("fixed", F.expr(f"flatten(array({', '.join(each)}))")).withColumn(
        "base", F.expr("filter(fixed, c -> c.holds)"))
    apart = "NOT exists(base, b -> b.start < c.end AND c.start < b.end)"
    more = (f"transform(filter(found_further, c -> {apart}), c -> named_struct('kind', {further_kind()}, 'start', c.start, 'end', c.end, "
            "'match', c.match, 'before', c.before, 'digits', c.digits, 'holds', false))")
    found = found.withColumn("every", F.expr(f"concat(fixed, {more})"))
    judged = F.expr(f"transform(every, c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end, 'holds', c.holds, "
                    f"'size', least(3, CAST(length(c.match) / 8 AS INT)), 'votes', {votes()}))")
    return found.select(key, F.expr("transform(base, c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end))").alias("base"),
                        judged.alias("judged"))


def reliabilities(counts: list[tuple[str, tuple[int, ...], int]], rounds: int = 60) -> tuple[dict[str, float], list[list[float]]]:
    """Expectation-maximisation on ``(kind, votes, rows)``.

    Returns each kind's prior log odds, and for each labeler the log odds that its no, its silence
    and its yes add. Posteriors start at the sum of the votes; every count is smoothed by one.
    """
    belief = {(k, v): 1 / (1 + math.exp(-1.5 * sum(v))) for k, v, _ in counts}
    prior: dict[str, float] = {}
    odds: list[list[float]] = []
    for _ in range(rounds):
        odds = []
        for j in range(len(LABELERS)):
            yes, no = [1.0, 1.0, 1.0], [1.0, 1.0, 1.0]
            for k, v, n in counts:
                yes[v[j] + 1] += n * belief[k, v]
                no[v[j] + 1] += n * (1 - belief[k, v])
            odds.append([math.log(a / sum(yes)) - math.log(b / sum(no)) for a, b in zip(yes, no)])
        for kind in {k for k, _, _ in counts}:
            true = 1.0 + sum(n * belief[k, v] for k, v, n in counts if k == kind)
            rows = 2.0 + sum(n for k, v, n in counts if k == kind)
            share = min(0.98, max(0.02, true / rows))
            prior[kind] = math.log(share / (1 - share))
        belief = {(k, v): 1 / (1 + math.exp(-max(-30.0, min(30.0, prior[k] + sum(o[x + 1] for o, x in zip(odds, v)))))) for k, v, _ in counts}
    return prior, odds


INPUTS = [f"CAST(c.kind = '{k}' AS DOUBLE)" for k in KINDS] + [
    f"CAST(c.votes[{j}] = {v} AS DOUBLE)" for j in range(len(LABELERS)) for v in (-1, 1)] + [
    f"CAST(c.size = {n} AS DOUBLE)" for n in range(3)]


def classifier(found: DataFrame) -> tuple[float, list[float]] | None:
    """Intercept and weights of INPUTS, learned from the candidates of all documents; None without candidates."""
    patterns = session.stage(found.select(F.explode("judged").alias("c")).groupBy("c.kind", "c.size", "c.votes").agg(F.count(F.lit(1)).alias("n")))
    grouped = patterns.groupBy("kind", "votes").agg(F.sum("n").alias("n"))
    counts = [(k, tuple(v), n) for k, v, n in grouped.collect()]  # at most kinds * 3 ** labelers rows
    if not counts:
        return None
    prior, odds = reliabilities(sorted(counts))
    start = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w!r}D" for k, w in sorted(prior.items())) + " END"
    added = [f"element_at(array({', '.join(f'{x!r}D' for x in o)}), votes[{j}] + 2)" for j, o in enumerate(odds)]
    soft = patterns.withColumn("p", F.expr(f"1 / (1 + exp(-({start} + {' + '.join(added)})))")).select(
        F.struct("kind", "size", "votes").alias("c"), F.explode(F.array(
            F.struct(F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("weight")),
            F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("weight")))).alias("s"))
    rows = soft.where("s.weight > 0").select("s.*", *(F.expr(e).alias(f"x{n}") for n, e in enumerate(INPUTS))).coalesce(1)
    rows = VectorAssembler(inputCols=[f"x{n}" for n in range(len(INPUTS))], outputCol="features").transform(rows)
    model = LogisticRegression(maxIter=40, regParam=0.01, weightCol="weight", standardization=False, family="binomial").fit(rows)
    return float(model.intercept), [float(w) for w in model.coefficients]


def detected(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, ``base`` and ``spans`` of every document: arrays of kind, start, end (exclusive, code points).

    ``base`` holds the four fixed kinds, ``spans`` these and the further candidates the classifier takes
    (none where it saw no candidates). Both are ordered by start, then kind as in KINDS. A null text
    reads as empty and has none. Repeated rows are reported once each, null keys pass; other columns
    are not read.
    """
    found = session.stage(candidates(docs, key))
    learned = classifier(found)
    more = "cast(array() as array<struct<kind:string,start:int,end:int>>)"
    if learned:
        intercept, weights = learned
        logit = " + ".join([f"{intercept!r}D", *(f"{w!r}D * {e}" for w, e in zip(weights, INPUTS))])
        more = (f"transform(filter(judged, c -> c.kind IN ({', '.join(repr(k) for k in FURTHER)}) AND {logit} >= 0), "
                "c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end))")
    order = quoted(KINDS)
    by_start = (f"(a, b) -> CASE WHEN a.start <> b.start THEN a.start - b.start "
                f"ELSE CAST(array_position({order}, a.kind) - array_position({order}, b.kind) AS INT) END")
    return found.select(key, F.expr(f"array_sort(base, {by_start})").alias("base"), F.expr(f"array_sort(concat(base, {more}), {by_start})").alias("spans"))


def joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def counted(spans: str, kind: str) -> Column:
    return F.expr(f"CAST(size(filter({spans}, s -> s.kind = '{kind}')) AS BIGINT)")
