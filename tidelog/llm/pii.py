"""Personal data by weak supervision.

Base spans follow fixed rules. Further candidates (local phone numbers, identity numbers, spelled-out addresses, names,
secrets such as tokens and keys) are judged by labelers that may each vote for, against, or not at all: a strict form, a
gazetteer, words of the context for and against, the neighbouring characters, and the variety of the characters.
Expectation-maximisation over the counts of vote patterns estimates the reliability of each labeler and the share of
true spans of each kind. A logistic classifier of what a span itself looks like (its length, letters, digits and
neighbours, no votes) is then trained on the resulting labels and decides.

All that touches texts is built-in expressions. Only counts by vote pattern and by features reach the driver: at most
some ten thousand rows, whatever the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

# The rules of the base kinds, in the order in which ties are sorted. They are written so that a scan is
# linear: a match can only begin where a run of its characters does, or where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BASE = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
IP_VALID = rf"^(?:{_PART}\.){{3}}{_PART}$"

# Given names, titles, and how issued secrets begin.
NAMES = """Adam Adrian Agnes Aisha Albert Alejandro Alex Alexander Alexandra Alice Ana Andrea Andrew Angela Anna Anne
Antoine Antonio Arthur Barbara Beatrice Benjamin Bernard Bianca Brian Bruno Camille Carl Carla Carlos Carmen Caroline
Catherine Charles Charlotte Chloe Christian Christine Christopher Claire Clara Claudia Daniel David Deborah Diana Diego
Dorothy Edward Elena Elizabeth Emily Emma Eric Erika Eva Felix Fernando Francesca Francis Francois Franz Frederic
Friedrich Gabriel George Gerhard Giovanni Giulia Grace Hans Harald Heinrich Helen Helena Henry Ingrid Irene Isabel Jacques
James Jan Jane Javier Jean Jennifer Jessica Joan John Jonathan Jorge Jose Joseph Juan Julia Julian Jurgen Karen Karl
Katharina Kevin Klaus Laura Lea Leon Linda Lisa Louis Louise Luca Lucas Lucia Luis Manuel Marco Margaret Maria Marie Mark
Martin Martina Mary Matthew Maximilian Michael Michelle Miguel Monika Nadia Nancy Nicolas Nina Olga Oliver Olivia Oscar
Pablo Patricia Patrick Paul Paula Pedro Peter Philip Pierre Rachel Rafael Richard Robert Rosa Ruth Samuel Sandra Sara Sarah
Sebastian Silvia Simon Sofia Stefan Stephanie Susan Thomas Ursula Victor Vincent Walter William Wolfgang""".split()
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Mme Sra".split()
ISSUED = "AIza AKIA ASIA SG. eyJ ghp_ gho_ github_pat_ glpat- npm_ sk- sk_live_ sk_test_ xoxb- xoxp-".split()
# Words before a span that speak for it and against it.
PERSON = r"(?i)(?:phone|tel|call|mobile|fax|contact|(?:e-?)?mail|write to|name is|named|signed|ssn|social security|passport|telefon|téléphone|teléfono|nombre|nom|name)\b[^\n]{0,20}$"
SECRET = r"(?i)(?:token|secret|passw(?:or)?d|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|bearer|authorization|credentials?)\b[^\n]{0,8}$"
NUMBERED = r"(?i)(?:version|isbn|order|invoice|token|key|hash|licen[cs]e|copyright|page|figure|serial|model|build|ref)\b[^\n]{0,20}$"
DERIVED = r"(?i)(?:sha-?[0-9]*|md5|commit|checksum|digest|hash|uuid|revision|etag|integrity|doi|url|href|src|path|file)\b[^\n]{0,8}$"

#: Candidates beyond the base, by kind, and what shows early that a text holds one.
MORE = {
    "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "id": r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]++)++",
    "name": rf"(?<![\p{{L}}])(?:(?:{'|'.join(TITLES)})\.? [A-Z][\p{{Ll}}]++|(?:{'|'.join(NAMES)}) [A-Z][\p{{Ll}}]++)(?![\p{{L}}])",
    "secret": r"(?<![A-Za-z0-9+/_.-])(?=[A-Za-z+/_.-]*+[0-9])(?=[0-9+/_.-]*+[A-Za-z])[A-Za-z0-9+/_.-]{20,}+={0,2}",
}
HINTS = {"phone": r"[0-9]{3}\)?[ .-][0-9]{3}", "id": r"[0-9]-[0-9]{2}-[0-9]", "email": r"[\[(](?:at|AT)[\])]", "name": None, "secret": r"[A-Za-z0-9+/_.-]{20}"}
KINDS = ["email", "ip", "card", "phone", "name", "id", "secret"]
LABELERS = ["form", "gazetteer", "context", "against", "neighbours", "variety"]
#: What the classifier sees of a span, each a small number.
FEATURES = ["rank", "size", "letters", "digits", "distinct", "before", "after"]
#: Characters before a span that the context labelers read.
CONTEXT = 40
#: Steps of expectation-maximisation and of the classifier's training.
EM_STEPS, TRAIN_STEPS = 60, 300
#: What a candidate is taken for before any vote is known, and the least probability of a span.
PRIOR, THRESHOLD = 0.5, 0.5


def spans(text: Column, pattern: str, hint: Column | None = None) -> Column:
    """array<struct<start, end, text>> of the leftmost matches that don't overlap, in code points.

    Places are sums of the lengths of matches and of the gaps between them.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["match"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["match"].alias("text")))).alias("out"))

    both = F.zip_with(matches, gaps, lambda m, g: F.struct(m.alias("match"), F.length(g).alias("gap")))
    found = F.aggregate(F.filter(both, lambda x: x["match"].isNotNull()), zero, step, lambda acc: acc["out"])
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")
    return found if hint is None else F.when(hint, found).otherwise(none)


def luhn(number: Column) -> Column:
    """Whether the digits of a text pass the Luhn test."""
    digits = F.reverse(F.regexp_replace(number, "[^0-9]", ""))
    values = F.transform(F.filter(F.split(digits, ""), lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^0-9]", ""))


def base_spans(text: Column) -> Column:
    """array<struct<start, rank, end>> of the base kinds, sorted; rank is the place in KINDS."""
    number = text.rlike("[0-9]")
    valid = {
        "email": (text.contains("@"), lambda m: F.lit(True)),
        "ip": (number & text.contains("."), lambda m: m.rlike(IP_VALID)),
        "card": (text.rlike("[0-9](?:[ -]?[0-9]){11}"), luhn),
        "phone": (text.contains("+"), lambda m: digits(m).between(9, 15)),
    }
    def ranked(kind: str) -> Column:
        hint, holds = valid[kind]
        found = F.filter(spans(text, BASE[kind], hint), lambda s: holds(s["text"]))
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end")))

    return F.array_sort(F.concat(*map(ranked, BASE)))


def vote(yes: Column, no: Column) -> Column:
    """1, 0, or -1 for no vote."""
    return F.when(yes, 1).when(no, 0).otherwise(-1)


def judged(text: Column, kind: str, s: Column) -> Column:
    """A candidate of that kind with the labelers' votes and the classifier's features."""
    m, at = s["text"], s["start"]
    before = F.substring(text, F.greatest(at - CONTEXT + 1, F.lit(1)), F.least(at, F.lit(CONTEXT)))
    after = F.substring(text, s["end"] + 1, F.lit(1))
    never = F.lit(False)
    distinct = F.size(F.array_distinct(F.split(m, "")))
    form = {
        "phone": vote(m.rlike(r"^\([0-9]{3}\) [0-9]{3}-[0-9]{4}$|^([0-9]{3})([.-])[0-9]{3}\2[0-9]{4}$"), m.rlike("^0")),
        "id": vote(~m.rlike("^(?:000|666|9)|-00-|-0000$"), m.rlike("^(?:000|666|9)|-00-|-0000$")),
        "email": vote(m.rlike(r"(?i)dot[\])] ?(?:com|org|net|edu|de|fr|es|eu)$"), never),
        "name": vote(m.rlike(rf"^(?:{'|'.join(TITLES)})\.? "), never),
        # even runs of hex digits, or all of capitals, small letters and digits; not words, paths or dates
        "secret": vote(m.rlike(r"^(?:(?:[0-9a-f]{2}){12,}|(?:[0-9A-F]{2}){12,})$") | (m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9].*[0-9].*[0-9]") & ~m.rlike(r"[/.]")), m.rlike(r"[/._-][A-Za-z]*[/._-]|[a-z]{9}|[A-Z]{12}|^[0-9._-]+T")),
    }
    listed = {
        "name": vote(m.rlike(rf"^(?:{'|'.join(NAMES)}) "), never),
        "phone": vote(m.rlike(r"^\(?[2-9][0-8][0-9]"), m.rlike(r"^\(?[01]")),
        "secret": vote(m.rlike(rf"^(?:{'|'.join(x.replace('.', chr(92) + '.') for x in ISSUED)})"), never),
    }
    secret = kind == "secret"
    touching = before.rlike(r"[0-9A-Za-z_\"'=/#]$") | after.rlike(r"^[0-9A-Za-z_\"'=/]")
    quoted = before.rlike(r"[\"'=:] ?$")
    linked = before.rlike(r"[/\\?&#%@]$|://[^ ]*$")
    votes = [
        form[kind],
        listed.get(kind, F.lit(-1)),
        vote(before.rlike(SECRET if secret else PERSON), never),
        vote(never, before.rlike(DERIVED if secret else NUMBERED)),
        vote(quoted & ~linked, linked) if secret else vote(never, touching),
        vote(distinct >= 10, distinct < 8) if secret else vote(never, distinct <= 3),
    ]
    beside = lambda c: F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike("[\"'`=:(\\[]"), 2).otherwise(3)
    share = lambda pattern: F.round(3 * F.length(F.regexp_replace(m, pattern, "")) / F.length(m)).cast("int")
    cells = {
        "rank": F.lit(KINDS.index(kind)),
        "size": F.least(F.length(m) / 8, F.lit(5)).cast("int"),
        "letters": F.when(m.rlike("[a-z]"), 1).otherwise(0) + F.when(m.rlike("[A-Z]"), 2).otherwise(0),
        "digits": share("[^0-9]"),
        "distinct": F.least(distinct / 5, F.lit(4)).cast("int"),
        "before": beside(F.substring(before, -1, 1)),
        "after": beside(after),
    }
    return F.struct(
        at.alias("start"),
        s["end"].alias("end"),
        *[v.cast("int").alias(n) for n, v in zip(LABELERS, votes, strict=True)],
        *[c.cast("int").alias(n) for n, c in cells.items()],
    )


def candidates(text: Column) -> Column:
    """array<struct<start, end, votes..., features...>> of the further kinds."""

    def of_kind(kind: str) -> Column:
        hint = text.rlike(HINTS[kind]) if HINTS[kind] else None
        return F.transform(spans(text, MORE[kind], hint), lambda s: judged(text, kind, s))

    return F.concat(*map(of_kind, MORE))


@dataclass
class Reliability:
    """How often a labeler votes for, against, and not at all on true and on false spans."""

    true: tuple[float, float, float]
    false: tuple[float, float, float]


def expectation_maximisation(patterns: list[tuple[int, tuple[int, ...], float]], steps: int = EM_STEPS) -> tuple[dict[int, float], list[Reliability], list[float]]:
    """(share of true spans of each kind, reliabilities, probability of each pattern) from counted (kind, votes, count).

    Starts from labelers that are right more often than wrong, so that "true" keeps its sense.
    """
    share = {kind: PRIOR for kind, _, _ in patterns}
    known = [Reliability((0.5, 0.15, 0.35), (0.15, 0.5, 0.35)) for _ in LABELERS]
    beliefs: list[float] = [PRIOR] * len(patterns)
    for _ in range(steps):
        for k, (kind, votes, _) in enumerate(patterns):
            odds = math.log(share[kind] / (1 - share[kind]))
            for v, r in zip(votes, known, strict=True):
                slot = (1, 0, -1).index(v)
                odds += math.log(r.true[slot] / r.false[slot])
            beliefs[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for kind in share:
            own = [(n, b) for (of, _, n), b in zip(patterns, beliefs, strict=True) if of == kind]
            share[kind] = (sum(n * b for n, b in own) + 1) / (sum(n for n, _ in own) + 2)
        for j in range(len(LABELERS)):
            t, f = [1.0, 0.3, 0.7], [0.3, 1.0, 0.7]  # pseudo-counts keep the sense of a labeler without votes
            for (_, votes, n), b in zip(patterns, beliefs, strict=True):
                slot = (1, 0, -1).index(votes[j])
                t[slot] += n * b
                f[slot] += n * (1 - b)
            known[j] = Reliability(tuple(x / sum(t) for x in t), tuple(x / sum(f) for x in f))
    return share, known, beliefs


def train(rows: list[tuple[list[tuple[str, int]], float, float]], steps: int = TRAIN_STEPS) -> dict[tuple[str, int] | None, float]:
    """Weights of a logistic classifier of (features, soft label, count) by gradient ascent; None is the constant."""
    w: dict = {None: 0.0} | {f: 0.0 for x, _, _ in rows for f in x}
    total = sum(n for _, _, n in rows) or 1.0
    for _ in range(steps):
        slope = {f: -0.001 * v for f, v in w.items()}
        for x, y, n in rows:
            z = w[None] + sum(w[f] for f in x)
            d = n / total * (y - 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            slope[None] += d
            for f in x:
                slope[f] += d
        for f, s in slope.items():
            w[f] += 2.0 * s
    return w


def find_pii(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, spans (sorted array<struct<start, rank, end>>), base (those of the base rules).

    Null text counts as empty; texts of any length are read as a whole. A further span that overlaps a base span is left
    out. Without candidates no classifier is needed and base spans alone remain; a candidate at the threshold is a span.
    Repeated rows are answered each; no rows give no rows; other columns are not looked at.
    """
    text = F.col("text")
    rows = docs.select("doc_id", text_or_empty("text").alias("text"))
    found = materialize(rows.select("doc_id", base_spans(text).alias("base"), candidates(text).alias("more")), "spans")
    each = found.select(F.explode("more").alias("c")).select("c.*")
    counted = [(r["rank"], tuple(r[n] for n in LABELERS), float(r["count"])) for r in sorted(each.groupBy("rank", *LABELERS).count().collect())]
    _, _, beliefs = expectation_maximisation(counted)
    belief = each.groupBy(*FEATURES, *LABELERS).count()
    if counted:
        sure = docs.sparkSession.createDataFrame([(kind, *votes, b) for (kind, votes, _), b in zip(counted, beliefs, strict=True)], ", ".join(f"{c} int" for c in ("rank", *LABELERS)) + ", belief double")
        belief = belief.join(F.broadcast(sure), ["rank", *LABELERS])  # a row for each pattern of votes
    else:
        belief = belief.withColumn("belief", F.lit(PRIOR))
    learned = belief.groupBy(*FEATURES).agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("belief")).alias("hits")).collect()
    weights = train([([(f, r[f]) for f in FEATURES], r["hits"] / r["n"], float(r["n"])) for r in sorted(learned)])

    def chosen(c: Column) -> Column:
        z = F.lit(weights[None])
        for name in FEATURES:
            for f, w in sorted((f, w) for f, w in weights.items() if f and f[0] == name):
                z = z + F.when(c[name] == f[1], w).otherwise(0.0)
        return z >= math.log(threshold / (1 - threshold))

    apart = lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    more = F.transform(F.filter("more", lambda c: chosen(c) & apart(c)), lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end")))
    return found.select("doc_id", "base", F.array_sort(F.array_union("base", more)).alias("spans"))


def span_list(c: str) -> Column:
    """kind:start:end of sorted spans, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.col(c), lambda s: F.concat_ws(":", F.element_at(kind, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans, and n_spans, how many these are."""
    found = find_pii(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(span_list("base"), 256).alias("base_sha256"), span_list("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
