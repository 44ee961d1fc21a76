"""Personal data: fixed patterns, and spans added by weak supervision; DataFrame functions only.

Base spans are the leftmost non-overlapping matches of email, ip, card and phone patterns that pass their
checks. Patterns are written so that no place of a text is scanned more than a few times. A match's
place is the sum of the lengths of the pieces that splitting at the pattern leaves, and of the matches, before it.

Candidates for more overlap no base span and have one of five FORMS: a run of address and key characters with a digit or
an @; a number of nine digits or more; a title with capitalised names; a house number with a street; and what follows
"password =" or the like. LABELERS vote for (1) or against (-1) each or abstain: patterns, a checksum, gazetteers, and words around it.
For each form expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is; a
logistic classifier over FEATURES, fitted by Newton steps to the resulting probabilities, decides
which candidates become spans. All candidates are counted; labelers have two values but for one with three, so
that there are 5 x 3 x 2^8 vote patterns and 2^13 feature patterns at most, of which those that occur, a few hundred, go to the driver with their counts.

Edges: a null text is empty; an empty text has no spans; without candidates nothing is added; repeated
rows each count and each get their spans; an empty table gives no rows; other columns are carried through by find(), also those with names of inner columns.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkgrid.llm.tables import packed, stored, table, unpacked

KINDS = ("email", "ip", "card", "phone")
ADDED = ("secret", "number", "address", "name", "street")
FORMS = ("run", "digits", "named", "house", "value")
#: \G lets a match begin where the last ended; else matches begin at the begin of a run of characters only.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Gazetteers, fixed values.
TITLES = "Mrs?|Ms|Miss|Dr|Prof|Sir|Herrn?|Frau|Señora?|Sra?|Doña?|Monsieur|Madame|Mme|Mlle"
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Boulevard|Blvd|Drive|Court|Square|Terrace|Way"
WAYS = "straße|strasse|gasse|weg|platz|allee"
PLACES = "Calle|Avenida|Plaza|Paseo|Rue|Place|Chemin"
GIVEN = "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Anna|Maria|Peter|Hans|Klaus|Jürgen|Wolfgang|Ursula|Monika|Sabine|José|Juan|Carlos|Luis|Carmen|Ana|Isabel|Jean|Pierre|Michel|Marie|Sophie|Camille"
SECRETS = "password|passwd|passphrase|pwd|secret|contraseña|passwort|kennwort|mot de passe"
_RUN = r"(?:\G|(?<![A-Za-z0-9@._%+=/:-]))(?=[A-Za-z._%+=/:-]*+[0-9@])[A-Za-z0-9@._%+=/:-]{7,}+"
_VALUE = rf"(?<=(?i:{SECRETS}) {{0,2}}[:=] {{0,2}}[\"']?)(?![\"'\s])[^\s\"']{{6,64}}+"
_NAMED = rf"(?<![\p{{L}}\p{{N}}])(?:{TITLES})\.? \p{{Lu}}\p{{L}}++(?: \p{{Lu}}\p{{L}}++)?"
_HOUSE = rf"(?<![\p{{L}}\p{{N}}.])[0-9]{{1,5}} (?:\p{{Lu}}\p{{L}}++ ){{1,3}}?(?:{STREETS})(?![\p{{L}}\p{{N}}])|(?<!\p{{L}})(?:\p{{L}}*+(?<=\p{{L}}(?:{WAYS}))|(?:{PLACES})(?: \p{{L}}++){{1,4}}?,?) [0-9]{{1,4}}(?![\p{{L}}\p{{N}}])"
#: Candidates: runs, which most texts with digits have, and the other forms, which few texts have.
CANDIDATES = {"run": _RUN, "form": f"{_VALUE}|{_NAMED}|{_HOUSE}"}
#: What a text with another form has: each as wide as its pattern's begin, so written that most places fail at the first character.
HINTS = {
    "value": rf"(?=[pPsScCkKmM])(?i:{SECRETS}) {{0,2}}[:=]",
    "named": rf"(?<![\p{{L}}\p{{N}}])(?=[DFHMPS])(?:{TITLES})\.? \p{{Lu}}",
    "house": rf"(?<![\p{{L}}\p{{N}}.])[0-9]{{1,5}} \p{{Lu}}|(?=[sgwpa])(?:{WAYS}) [0-9]|(?<!\p{{L}})(?=[ACPR])(?:{PLACES}) \p{{L}}",
}
HINT = "|".join(HINTS.values())
#: A text must have these to have a match.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Matches whose places are summed up in one go.
STEP = 512
ROUNDS = 12
NEWTON = 6


def matches(text: Column, pattern: str) -> Column:
    """Matches, and of each piece between them the length, the last characters and the first ones."""
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.struct(F.length(p).alias("n"), F.right(p, F.lit(24)).alias("tail"), F.left(p, F.lit(12)).alias("head")))
    return F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), pieces.alias("pieces"))


def places(m: Column) -> Column:
    """Matches with begin and end, and what stands before and after them."""
    found, pieces = m.getField("found"), m.getField("pieces")
    count = F.size(found)

    def total(upto: Column) -> Column:
        a = F.aggregate(F.slice(pieces, F.lit(1), upto), F.lit(0), lambda s, p: s + p.getField("n"))
        return F.aggregate(F.slice(found, F.lit(1), upto), a, lambda s, f: s + F.length(f))

    def chunk(c: Column) -> Column:
        numbers = F.sequence(c * STEP, F.least(c * STEP + STEP, count) - 1)
        state = F.struct(total(c * STEP).alias("at"), F.array().cast("array<struct<begin:int,end:int,w:string,before:string,after:string>>").alias("out"))

        def step(s: Column, i: Column) -> Column:
            w, piece = F.get(found, i), F.get(pieces, i)
            begin = s.getField("at") + piece.getField("n")
            end = begin + F.length(w)
            one = F.struct(begin.alias("begin"), end.alias("end"), w.alias("w"), piece.getField("tail").alias("before"), F.get(pieces, i + 1).getField("head").alias("after"))
            return F.struct(end.alias("at"), F.concat(s.getField("out"), F.array(one)).alias("out"))

        return F.aggregate(numbers, state, step, lambda s: s.getField("out"))

    chunks = F.sequence(F.lit(0), F.floor((count - 1) / STEP).cast("int"))
    return F.when(count > 0, F.flatten(F.transform(chunks, chunk))).otherwise(F.array().cast("array<struct<begin:int,end:int,w:string,before:string,after:string>>"))


def digits(w: Column) -> Column:
    return F.regexp_replace(w, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def weighed(i: Column) -> Column:
        d = F.substring(F.reverse(number), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    summed = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(number)), weighed), F.lit(0), lambda s, d: s + d)
    return summed % 10 == 0


def passes(kind: str, w: Column) -> Column:
    n = F.length(digits(w))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(w, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.try_to_number(F.when(F.length(part(p)).between(1, 3), part(p)), F.lit("999")), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits(w))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def form(w: Column, before: Column) -> Column:
    """The number of a candidate's form in FORMS."""
    return (
        F.when(before.rlike(rf"(?i)({SECRETS}) {{0,2}}[:=] {{0,2}}[\"']?$"), 4)
        .when(w.rlike(rf"^(?:{TITLES})\.? \p{{Lu}}"), 2)
        .when(w.contains(" "), 3)
        .when(w.rlike("^[0-9]{9,}$"), 1)
        .otherwise(0)
    )


# Each labeler votes on a candidate c (w, before, after).
def labelers(c: Column) -> dict[str, Column]:
    w, before, after = c.getField("w"), c.getField("before"), c.getField("after")
    vote = lambda yes, no=None: F.when(yes, 1).when(no, -1).otherwise(0) if no is not None else F.when(yes, 1).otherwise(0)
    turns = F.regexp_count(w, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]"))
    number = w.rlike("^[0-9]{13,19}$")
    return {
        "shape": vote(w.rlike("^[0-9a-fA-F]{32,}$") | (w.rlike("^[A-Za-z0-9_=+/-]{20,}$") & (turns > 1))),
        "plain": F.when(w.rlike(r"^[0-9]{1,8}$|^[0-9]+[.:/-][0-9]+$|^[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}"), -1).otherwise(0),
        "issuer": vote(w.rlike(r"(?i)^(sk-|ghp_|akia|xox[bp]-|eyj|bearer)|@.*\.(com|org|net|edu|gov|io)$") | (number & w.rlike("^[3-6]"))),
        "words": vote(before.rlike(rf"(?i)(token|api[_ -]?key|key|bearer|phone|tel|mobile|call|e-?mail|account|iban|card|ssn|passport|contact|{SECRETS})[^A-Za-z0-9]{{0,6}}$")),
        "units": F.when(after.rlike(r"(?i)^ ?(%|km|kg|mb|gb|px|pages?|usd|eur|percent)") | before.rlike(r"(?i)(page|p\.|fig|figure|chapter|section|version|no\.|isbn|[$€£]) ?$"), -1).otherwise(0),
        "turns": F.when(c.getField("form") == 0, vote(turns >= 3, turns == 0)).otherwise(0),
        "checked": vote(F.when(number, luhn(w)).otherwise(False)),
        "listed": vote(w.rlike(rf"^(?:{TITLES})\.? \p{{Lu}}|[0-9] .*(?:{STREETS})$|^(?:{PLACES}) |(?:{WAYS}) [0-9]+$")),
        "given": vote(w.rlike(rf"(?<!\p{{L}})(?:{GIVEN})(?!\p{{L}})")),
    }


def features(c: Column) -> dict[str, Column]:
    w, before, after, kind = c.getField("w"), c.getField("before"), c.getField("after"), c.getField("form")
    return {
        "at": w.contains("@"),
        "long": F.length(w) >= 16,
        "longer": F.length(w) >= 32,
        "digits": w.rlike("^[0-9._+=/:-]+$"),
        "hex": w.rlike("^[0-9a-fA-F]+$"),
        "mixed": w.rlike("[0-9]") & w.rlike("[A-Za-z]"),
        "quoted": before.rlike("[\"']$") & after.rlike("^[\"']"),
        "assigned": before.rlike("[=:] ?[\"']?$"),
        "number": (kind == 1) & F.length(w).between(13, 19) & F.when(w.rlike("^[0-9]{13,19}$"), luhn(w)).otherwise(False),
        **{f: kind == k for k, f in enumerate(FORMS) if k},
    }


LABELERS = ("shape", "plain", "issuer", "words", "units", "turns", "checked", "listed", "given")
FEATURES = ("at", "long", "longer", "digits", "hex", "mixed", "quoted", "assigned", "number", *FORMS[1:])


def spans_of(docs: DataFrame) -> DataFrame:
    """docs without text, with the spans of each base kind, and the candidates with votes (v) and features (x)."""
    text = F.coalesce("text", F.lit(""))
    empty = F.lit(None).cast("struct<found:array<string>,pieces:array<struct<n:int,tail:string,head:string>>>")
    has = {k: text.contains(c) if c else text.rlike("[0-9]") for k, c in NEEDS.items()}
    has |= {"run": text.rlike("[0-9@]"), "form": text.rlike(HINT)}
    rows = docs.withColumns({f"_{k}": F.when(has[k], matches(text, p)).otherwise(empty) for k, p in {**PATTERNS, **CANDIDATES}.items()}).drop("text")
    rows = rows.withColumns({f"_{k}": F.coalesce(places(F.col(f"_{k}")), F.array().cast("array<struct<begin:int,end:int,w:string,before:string,after:string>>")) for k in (*KINDS, *CANDIDATES)})

    def passing(kind: str) -> Column:
        good = F.filter(f"_{kind}", lambda s: passes(kind, s.getField("w")))
        return F.transform(good, lambda s: F.struct(s.getField("begin").alias("begin"), s.getField("end").alias("end")))

    rows = rows.withColumns({f"_{k}": passing(k) for k in KINDS})
    base = F.concat(*[f"_{k}" for k in KINDS])
    rows = rows.withColumn("_base", base)
    apart = lambda c, of="_base": ~F.exists(of, lambda s: (s.getField("begin") < c.getField("end")) & (c.getField("begin") < s.getField("end")))
    rows = rows.withColumn("_cand", F.array_sort(F.concat(F.filter("_run", lambda c: apart(c, "_form")), "_form"))).drop(*[f"_{k}" for k in CANDIDATES])

    def described(c: Column) -> Column:
        v = F.struct(*[x.alias(n) for n, x in labelers(c).items()])
        x = F.struct(*[F.coalesce(x, F.lit(False)).cast("int").alias(n) for n, x in features(c).items()])
        return F.struct(c.getField("begin").alias("begin"), c.getField("end").alias("end"), c.getField("form").alias("form"), v.alias("v"), x.alias("x"))

    return rows.withColumn("_cand", F.transform(F.transform(F.filter("_cand", lambda c: apart(c)), lambda c: c.withField("form", form(c.getField("w"), c.getField("before")))), described)).drop("_base")


def _chance(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def probabilities(votes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How likely each vote pattern (a row, n times) is personal data, by expectation-maximisation over the labelers' reliabilities."""
    chance = _chance(1.5 * votes.sum(axis=1) - 1.0)
    for _ in range(ROUNDS):
        yes, no = (n * chance).sum(), (n * (1 - chance)).sum()
        odds = np.full(len(n), math.log((yes + 1) / (no + 1)))
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                hit = votes[:, j] == v
                odds[hit] += math.log(((n * chance)[hit].sum() + 0.1) / (yes + 0.3)) - math.log(((n * (1 - chance))[hit].sum() + 0.1) / (no + 0.3))
        chance = _chance(odds)
    return chance


def classifier(x: np.ndarray, chance: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Logistic weights, the intercept last, that fit the probabilities of feature patterns (a row, n times)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weights = np.zeros(x.shape[1])
    for _ in range(NEWTON):
        p = _chance(x @ weights)
        gradient = x.T @ (n * (chance - p)) - weights
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1])
        weights = weights + np.clip(np.linalg.solve(hessian, gradient), -4, 4)
    return weights


def learn(rows: DataFrame) -> list[float] | None:
    """Classifier weights, the intercept last."""
    seen = rows.select(F.explode("_cand").alias("c")).groupBy("c.form", *[f"c.v.{j}" for j in LABELERS], *[f"c.x.{f}" for f in FEATURES]).count().collect()
    if not seen:
        return None
    seen = np.array(sorted(seen), float)
    kind, votes, x, n = seen[:, 0], seen[:, 1 : 1 + len(LABELERS)], seen[:, 1 + len(LABELERS) : -1], seen[:, -1]
    chance = np.zeros(len(seen))
    for k in np.unique(kind):
        chance[kind == k] = probabilities(votes[kind == k], n[kind == k])
    return [round(float(w), 9) for w in classifier(x, chance, n)]


def find(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without text, with spans: (kind, begin, end) of base kinds, then added ones, each in order of begin."""
    docs = docs.drop("spans")
    others = [c for c in docs.columns if c != "text"]
    rows = stored(spans_of(packed(docs, "text")))
    model = learn(rows)
    named = lambda k: F.transform(f"_{k}", lambda s: F.struct(F.lit(k).alias("kind"), s.getField("begin").alias("begin"), s.getField("end").alias("end")))
    parts = [named(k) for k in KINDS]
    if model is not None:
        weights = model

        def wanted(c: Column) -> Column:
            x = c.getField("x")
            return sum((x.getField(f) * w for f, w in zip(FEATURES, weights)), F.lit(weights[-1])) >= math.log(threshold / (1 - threshold))

        def kind(c: Column) -> Column:
            x = c.getField("x")
            return F.when(x.getField("named") == 1, "name").when(x.getField("house") == 1, "street").when(x.getField("value") == 1, "secret").when(x.getField("at") == 1, "address").when(x.getField("digits") == 1, "number").otherwise("secret")

        rows = rows.withColumn("_more", F.transform(F.filter("_cand", wanted), lambda c: F.struct(kind(c).alias("kind"), c.getField("begin").alias("begin"), c.getField("end").alias("end"))))
        of = lambda k: F.filter("_more", lambda s: s.getField("kind") == k)
        parts += [of(k) for k in ADDED]
    return unpacked(rows.withColumn("spans", F.concat(*parts)), others, (), "spans")


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.getField("kind"), s.getField("begin").cast("string"), s.getField("end").cast("string"))), ",")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s.getField("kind").isin(*KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s.getField("kind") == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(written(base), 256).alias("base_sha256"), F.size("spans").cast("long").alias("n_spans"), written(F.col("spans")).alias("spans"))
