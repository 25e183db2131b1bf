"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

DataFrame operations only. Candidate spans come from patterns: four base kinds whose valid matches
always stay, and wider ones (obfuscated addresses, national phone numbers, account and social security
numbers, base matches that failed their test). Four labelers vote +1, -1 or abstain on each candidate:
format (checksum, ranges, digit counts), gazetteer (known domains, prefixes, ranges), context (words in front)
and shape (surroundings and separators). Expectation-maximisation estimates how far each
labeler can be trusted, without labels; a logistic span classifier learns from its posteriors and
scores each candidate from kind, votes and length.

EM and the classifier work on counts of vote patterns: kinds x 3 ** labelers x lengths rows at most, whatever
the input. All candidates of all documents are counted.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of equal starts; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: name: (kind, pattern, what a text must hold, for a cheap first test). Quantifiers are possessive where
#: nothing that follows could match what they give back; an address or number may start only where its run of characters does
#: or where the last match ended, which finds the same leftmost matches without trying each place within a run.
PATTERNS = {
    "email": ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": ("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    "hidden_email": ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{2,63}+(?: ?(?:\[dot\]|\(dot\)) ?[A-Za-z0-9-]{2,63}+|\.[A-Za-z0-9-]{2,63}+)++", r"[\[(]at[\])]"),
    "national_phone": ("phone", r"(?<![0-9A-Za-z+().-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{3}[ .-][0-9]{4}"),
    "iban": ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"),
    "ssn": ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
}
BASE = ("email", "ip", "card", "phone")
LABELERS = ("format", "gazetteer", "context", "shape")
#: Fixed word lists of the labelers.
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "it", "nl", "ch", "at", "us", "ca", "au", "jp")
CONTEXT = {
    "email": "mail|contact|write|reply|kontakt|correo|courriel|schreib",
    "ip": "address|addr|server|host|client|login|adresse|remote",
    "card": "card|visa|master|amex|credit|karte|carte|tarjeta|pay",
    "phone": "phone|tel|call|fax|mobile|cell|anruf|appel|llam|contact",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|insurance",
}
AGAINST = "version|release|order|invoice|isbn|token|sku|serial|build|section|chapter|hash|commit|doi|page"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, even where it stands inside of another lambda."""
    return F.transform(F.array(value), body)[0]


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, text>>: leftmost non-overlapping matches with their places in code points.

    Places are sums of the lengths in front, by blocks of 128, so that many matches in a long text stay cheap.
    """
    block = 128

    def place(s: Column) -> Column:
        steps = F.transform(s.m, lambda x, i: F.length(x) + F.length(s.p[i]))
        return let(F.struct(s.m.alias("m"), s.p.alias("p"), steps.alias("steps")), blocks)

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda a, x: a + x)

    def blocks(s: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(s.m) - 1) / block).cast("int")), lambda b: total(F.slice(s.steps, b * block + 1, block)))
        return let(sums, lambda x: let(F.transform(x, lambda _, b: total(F.slice(x, F.lit(1), b))), lambda before: starts(s, before)))

    def starts(s: Column, before: Column) -> Column:
        return F.transform(
            s.m,
            lambda x, i: F.struct(
                (before[F.floor(i / block).cast("int")] + total(F.slice(s.steps, (F.floor(i / block) * block + 1).cast("int"), i % block)) + F.length(s.p[i])).alias("start"), x.alias("text")
            ),
        )

    none = F.array().cast("array<struct<start:int,text:string>>")
    found = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return let(found, lambda s: F.when(F.size(s.m) > 0, place(s)).otherwise(none))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits from the right, every second doubled (and less 9 if over 9), sum to a multiple of ten."""
    single = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), lambda d, i: let(d.cast("int") * (1 + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    return F.aggregate(single, F.lit(0), lambda a, x: a + x) % 10 == 0


def _iban(x: Column) -> Column:
    """Whether the rearranged number, letters as 10 to 35, leaves 1 by 97."""
    flat = F.regexp_replace(x, " ", "")
    turned = F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4))
    chars = F.regexp_extract_all(turned, F.lit("[A-Z0-9]"), F.lit(0))
    return F.aggregate(chars, F.lit(0), lambda a, c: let(F.ascii(c), lambda k: F.when(k >= 65, (a * 100 + k - 55) % 97).otherwise((a * 10 + k - 48) % 97))) == 1


def valid(name: str, x: Column) -> Column:
    """The format test of a pattern's match."""
    if name == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return x.rlike(rf"^(?:{part}\.){{3}}{part}$")
    if name == "card":
        return let(_digits(x), lambda d: F.length(d).between(14, 19) & _luhn(d))
    if name == "phone":
        return F.length(_digits(x)).between(10, 15)
    if name == "iban":
        return _iban(x)
    if name == "ssn":
        return ~x.rlike(r"^(?:000|666|9[0-9]{2})-|-00-|-0000$")
    return F.lit(True)


def _votes(name: str, kind: str, text: Column, start: Column, x: Column, good: Column) -> dict[str, Column]:
    """The labelers' votes on one match: 1, -1 or 0 for none."""
    def sign(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    front = F.lower(text.substr(F.greatest(start - 39, F.lit(1)), F.least(start, F.lit(40))))
    if kind == "email":
        top = F.lower(F.substring_index(x, ".", -1))
        known = sign(top.isin(*TOP_DOMAINS), top.rlike("^[0-9]+$") | (F.length(top) < 2))
    elif kind == "ip":
        known = sign(x.rlike(r"^(?:10|172|192|1[0-9][0-9]|[2-9][0-9])\."), x.rlike(r"^0+\.|^(?:2[3-9][0-9])\.|^[0-9]\.[0-9]\.[0-9]\.[0-9]$"))
    elif kind == "card":
        known = let(_digits(x), lambda d: sign(d.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)") & F.length(d).between(14, 19), ~d.rlike("^[2-6]")))
    elif kind == "phone":
        known = sign(x.rlike(r"^\+(?:1|7|2[07]|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1-6]|9[0-58])"), _digits(x).rlike(r"^(?:0{3}|1{3}|1234)"))
    elif kind == "iban":
        known = sign(x.rlike("^(?:DE|FR|ES|IT|NL|GB|CH|AT|BE|PT|IE|LU|PL|SE|DK|NO|FI)"), x.rlike("^(?:X|Q)"))
    else:
        known = F.lit(0)
    before, after = text.substr(start, F.lit(1)), text.substr(start + F.length(x) + 1, F.lit(1))
    glued = before.rlike("[A-Za-z0-9_/=#]") | after.rlike("[A-Za-z0-9_/=#]")
    return {
        "format": sign(good, ~good),
        "gazetteer": known,
        "context": sign(front.rlike(CONTEXT[kind]), front.rlike(AGAINST)),
        "shape": sign(~glued & x.rlike(r"[@. ()-]"), glued),
    }


def candidates(text: Column) -> Column:
    """array<struct<kind, start, end, base, votes..., size>> of a text: all candidate spans."""
    none = F.array().cast("array<struct<kind:int,start:int,end:int,base:boolean,format:int,gazetteer:int,context:int,shape:int,size:int>>")

    def one(name: str) -> Column:
        kind, pattern, needs = PATTERNS[name]

        def span(m: Column) -> Column:
            good = valid(name, m.text)
            votes = _votes(name, kind, text, m.start, m.text, F.lit(True) if name not in ("ip", "card", "phone", "iban", "ssn") else good)
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), m.start.cast("int").alias("start"), (m.start + F.length(m.text)).cast("int").alias("end"), (good if name in BASE else F.lit(False)).alias("base"),
                *[votes[v].cast("int").alias(v) for v in LABELERS], F.least(F.floor(F.length(m.text) / 8), F.lit(3)).cast("int").alias("size"),
            )

        found = matches(text, pattern)
        if name == "card":  # short runs of digits are no candidates
            found = F.filter(found, lambda m: F.length(m.text) >= 13)
        first = F.contains(text, F.lit("@")) if name == "email" else text.rlike(needs)
        return F.when(first, F.transform(found, span)).otherwise(none)

    return F.concat(*[one(name) for name in PATTERNS])


def with_candidates(docs: DataFrame, text_col: str, to: str) -> DataFrame:
    """Adds the candidates; wide ones that overlap a valid base span are left out, null texts have none."""
    found = docs.withColumn(to, candidates(F.coalesce(F.col(text_col), F.lit(""))))
    base = F.filter(to, lambda c: c.base)

    def apart(all_of: Column) -> Column:
        return F.filter(all_of.every, lambda c: c.base | ~F.exists(all_of.base, lambda b: (b.start < c.end) & (c.start < b.end)))

    return found.withColumn(to, F.when(F.size(to) > 0, let(F.struct(F.col(to).alias("every"), base.alias("base")), apart)).otherwise(F.col(to)))


def reliabilities(kind: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Posterior of each vote pattern by EM: hidden truth, labelers independent given it, starting from their majority."""
    post = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
    for _ in range(rounds):
        log = np.zeros((len(n), 2))
        for z, w in ((0, n * (1 - post)), (1, n * post)):
            by_kind = np.bincount(kind, w, len(KINDS))
            both = np.bincount(kind, n, len(KINDS))
            log[:, z] += np.log((by_kind[kind] + 1) / (both[kind] + 2))
            for j in range(votes.shape[1]):
                share = (np.bincount(votes[:, j] + 1, w, 3) + np.where(np.arange(3) - 1 == 2 * z - 1, 2.0, 1.0)) / (w.sum() + 4)
                log[:, z] += np.log(share[votes[:, j] + 1])
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -30, 30)))
    return post


def _features(kind: np.ndarray, votes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One-hot kind, votes and length class."""
    return np.concatenate([np.eye(len(KINDS))[kind], *[np.eye(3)[votes[:, j] + 1] for j in range(votes.shape[1])], np.eye(4)[size]], axis=1)


def train(found: DataFrame, column: str) -> np.ndarray:
    """Weights of the span classifier, from the counts of all candidates' patterns; no candidates: zeros."""
    width = len(KINDS) + 3 * len(LABELERS) + 4
    rows = found.select(F.explode(column).alias("c")).groupBy("c.kind", *[f"c.{v}" for v in LABELERS], "c.size").count().collect()
    if not rows:
        return np.zeros(width)
    kind, size, n = (np.asarray([r[k] for r in rows]) for k in ("kind", "size", "count"))
    votes = np.asarray([[r[v] for v in LABELERS] for r in rows])
    goal, x, n = reliabilities(kind, votes, n.astype(float)), _features(kind, votes, size), n / n.sum()
    w = np.zeros(width)
    for _ in range(30):  # Newton's steps on the weighted, lightly penalised log-loss
        p = 1 / (1 + np.exp(-x @ w))
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(width)
        w = w - np.linalg.solve(hessian, x.T @ (n * (p - goal)) + 1e-3 * w)
    return w


def score(c: Column, weights: np.ndarray) -> Column:
    """The classifier's probability for a candidate."""
    k = len(KINDS)
    total = F.element_at(F.lit(weights[:k].tolist()), c.kind + 1)
    for j, v in enumerate(LABELERS):
        total = total + F.element_at(F.lit(weights[k + 3 * j : k + 3 * j + 3].tolist()), c[v] + 2)
    total = total + F.element_at(F.lit(weights[-4:].tolist()), c["size"] + 1)
    return 1 / (1 + F.exp(-total))


def decided(found: DataFrame, column: str, least: float = 0.9) -> DataFrame:
    """Replaces the candidates by the spans that stay, in order of start, then kind: all base spans, and others scored at least ``least``."""
    weights = train(found, column)
    kept = F.filter(column, lambda c: c.base | ((c.format > 0) & (score(c, weights) >= least)))
    return found.withColumn(column, F.array_sort(F.transform(kept, lambda c: F.struct(c.start.alias("start"), c.kind.alias("kind"), c.end.alias("end"), c.base.alias("base")))))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    names = F.lit(list(KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def digest(spans: DataFrame, column: str, id_col: str) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    kinds = F.transform(F.filter(column, lambda s: s.base), lambda s: s.kind)
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    base = joined(F.filter(column, lambda s: s.base))
    return spans.select(id_col, *counts, F.sha2(base, 256).alias("base_sha256"), joined(F.col(column)).alias("spans"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", to: str = "spans") -> DataFrame:
    """The documents with their spans: array<struct<start, kind, end, base>>, ``kind`` an index of KINDS.

    Null and empty texts have no spans. Null ids and repeated rows stay as they are; a column named ``to`` is replaced. Places
    count code points, ends are exclusive. An empty table gives an empty one.
    """
    return decided(with_candidates(docs, text_col, to), to)


def masked(docs: DataFrame, text_col: str = "text", spans: str = "spans") -> DataFrame:
    """Texts with [KIND] in place of every span (of overlapping ones the first, up to the last one's end); drops the spans."""
    text, names = F.col(text_col), F.lit([f"[{k.upper()}]" for k in KINDS])

    def step(a: Column, s: Column) -> Column:
        over = s.start < a.at
        said = F.when(over, a.said).otherwise(F.concat(a.said, text.substr(a.at + 1, s.start - a.at), F.element_at(names, s.kind + 1)))
        return F.struct(F.greatest(a.at, s.end).alias("at"), said.alias("said"))

    whole = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("said")), step, lambda a: F.concat(a.said, text.substr(a.at + 1, F.length(text))))
    return docs.withColumn(text_col, F.when(F.size(spans) > 0, whole).otherwise(text)).drop(spans)
