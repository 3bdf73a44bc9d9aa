"""PII: labelers vote on candidate spans, expectation-maximisation weighs them, a span classifier decides.

Every step over the data is a DataFrame expression. Candidates are found in the row that holds the text; for
the fit they are counted by votes and features, which makes a table whose size depends on the labelers
alone. The fit on that table is a few lines of arithmetic on the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotmeter.session import materialize

#: Kinds of candidates. The first four have base rules; the possessive forms match what the plain ones
#: do, in linear time: a local part starts where no other could, and nothing that follows a
#: repetition needs it to give back. ``\G`` is the end of the match before.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_/+])[A-Za-z0-9_/+]{24,}+",
}
#: A text without this has no candidate of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "secret": None}

# Endings of mail hosts that are in use, and those that never are; country calling codes;
# address ranges that belong to nobody; first digits of card issuers; prefixes of keys.
MAIL_ENDINGS = (
    "com org net edu gov mil int info biz name pro aero coop museum jobs mobi travel cat tel asia post xyz online site shop store app dev "
    "io ai co me tv cc ws eu ac ad ae ag al am ar at au az ba be bg bo br by ca ch cl cn cr cu cy cz de dk do dz ec ee eg es fi fr ge gr gt hk "
    "hn hr hu id ie il in iq ir is it jm jo jp ke kr kw kz lb li lk lt lu lv ly ma mc md mk mt mx my ng ni nl no np nz om pa pe ph pk pl pr "
    "pt py qa ro rs ru sa se sg si sk sn sv sy th tn tr tw tz ua ug uk us uy uz ve vn za"
).split()
UNUSED_ENDINGS = "example invalid test local localhost localdomain internal lan".split()
CALLING_CODES = (
    r"^\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[0578][0-9]"
    r"|9[679][0-9])"
)
UNASSIGNED = r"^(0|127|22[4-9]|23[0-9]|24[0-9]|25[0-9])\."
ISSUERS = "^(3[0-689]|4|5[0-8]|2[2-7]|6)"
KEYS = "^(sk|pk|rk|ghp|gho|ghs|glpat|xox[abp]|AKIA|ASIA|AIza|eyJ)"

# Words that stand before each kind, in English, French, German and Spanish.
CUES = {
    "email": (
        "mail email e-mail mailto contact reach write courriel mél adresse contacter écrire écrivez mailadresse schreiben kontakt "
        "erreichbar correo electrónico contacto escribir escriba dirección"
    ).split(),
    "ip": (
        "ip ipv4 host server client login address remote serveur hôte connexion adresse rechner anmeldung zugriff servidor cliente "
        "conexión equipo dirección"
    ).split(),
    "card": (
        "card cards visa mastercard amex maestro credit debit cvv carte bancaire crédit kreditkarte karte kartennummer "
        "debitkarte tarjeta crédito débito"
    ).split(),
    "phone": (
        "phone telephone tel call calls mobile cell fax whatsapp sms téléphone tél portable appeler appelez télécopie telefon handy "
        "mobil rufnummer anrufen durchwahl teléfono móvil celular llamar llame"
    ).split(),
    "secret": (
        "token key secret password passwd pwd apikey api_key api-key access_key secret_key bearer auth authorization credential "
        "jeton clé mot-de-passe schlüssel passwort kennwort geheimnis clave contraseña secreto"
    ).split(),
}
#: Words before numbers that belong to nobody, in the same languages.
OTHER_CUES = (
    "order orders invoice version release isbn issn sku serial item article ticket tracking reference ref page volume build commit checksum "
    "commande facture référence numéro-de-série colis bestellung rechnung artikel seriennummer sendung aktenzeichen "
    "pedido factura referencia serie paquete versión"
).split()
LABELERS = ("rule", "gazetteer", "cue", "shape", "edges")
#: Labelers that may abstain, by place: most spans have no cue beside them, and no gazetteer knows all endings.
ABSTAINING = (1, 2)

#: Features of the final classifier and the number of values of each.
FEATURES = {"votes": 2 ** (len(LABELERS) + len(ABSTAINING)), "size": 16, "before": 8, "after": 8}
#: Chances of a yes with which each labeler begins, and how many votes that is worth: among personal spans, among those that
#: look like them and are not, and among pieces of something else.
EXPECTED = {
    "rule": (0.98, 0.03, 0.03), "gazetteer": (0.8, 0.3, 0.3), "cue": (0.9, 0.02, 0.02), "shape": (0.9, 0.9, 0.1), "edges": (0.9, 0.9, 0.3),
}
WORTH = 20.0
#: The rule labeler says what the first class is: its chances stay above and below these, whatever the other votes have in common.
TIE = (0.95, 0.05)
#: Rounds of expectation-maximisation, and what counts add to every cell.
ROUNDS, SMOOTHING = 25, 1.0

#: Characters before a match in which cues are looked for.
CONTEXT = 32

SPAN = "struct<kind:int,start:int,end:int>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Digits from the right, every second one doubled, sum to a multiple of ten."""
    def value(i: Column) -> Column:
        digit = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))
    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(F.transform(places, value), F.lit(0), lambda x, y: x + y) % 10 == 0


def base_valid(kind: str, x: Column) -> Column:
    """Whether a match of a base kind passes its rule; other kinds have none."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        short = F.transform(F.split(x, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(short, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))
    digits = _digits(x)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(False)


def _votes(kind: str, x: Column, before: Column, after: Column) -> list[Column]:
    """The vote of each labeler about a match ``x`` between two pieces of text: 1 is yes, 0 no, null none.

    The cue labeler looks at all words before the match: one that goes with the kind is a yes, one that goes with
    another kind or with numbers of things a no. A word that the piece cuts is no word.
    """
    digits = _digits(x)
    rule = base_valid(kind, x) if kind in BASE_KINDS else (x.rlike("[0-9]") & x.rlike("[A-Za-z]"))
    ending = F.lower(F.regexp_extract(x, r"([A-Za-z]+)$", 1))
    known = {
        "email": F.when(ending.isin(*MAIL_ENDINGS), 1).when(ending.isin(*UNUSED_ENDINGS), 0),
        "ip": F.when(x.rlike(UNASSIGNED), 0),
        "card": digits.rlike(ISSUERS).cast("int"),
        "phone": x.rlike(CALLING_CODES).cast("int"),
        "secret": F.when(x.rlike("^([0-9a-f]+|[0-9A-F]+)$") | x.rlike(KEYS), 1),
    }[kind]
    shape = {
        "email": F.length(x).between(6, 64),
        "ip": F.length(x).between(7, 15),
        "card": F.length(digits).between(13, 19) & (F.length(x) <= 23),
        "phone": F.length(digits).between(10, 12),
        "secret": F.length(x).between(24, 128),
    }[kind]
    edges = before.rlike(r"(^|[\s(\[\"'<:=])$") & after.rlike(r"^([\s)\]\"'>,.;:!?#$%&*]|$)")
    whole = F.when(F.length(before) > CONTEXT, F.regexp_replace(before, r"^[\p{L}\p{N}_-]+", "")).otherwise(before)
    words = F.split(F.lower(whole), r"[^\p{L}\p{N}_-]+")
    others = {w for other, cues in CUES.items() if other != kind for w in cues} | set(OTHER_CUES)
    beside = F.when(F.arrays_overlap(words, _words(CUES[kind])), 1).when(F.arrays_overlap(words, _words(others - set(CUES[kind]))), 0)
    return [rule.cast("int"), known, beside, shape.cast("int"), edges.cast("int")]


def _words(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in sorted(words)])


def votes_code(votes: list[Column]) -> Column:
    """One number for the votes: a bit for each yes, then a bit for each labeler that abstains."""
    yes = sum((F.coalesce(vote, F.lit(0)) * 2 ** k for k, vote in enumerate(votes)), F.lit(0))
    return yes + sum((votes[k].isNull().cast("int") * 2 ** (len(LABELERS) + i) for i, k in enumerate(ABSTAINING)), F.lit(0))


def ballots(code: int) -> list[int | None]:
    """The votes behind a number of :func:`votes_code`."""
    silent = {k for i, k in enumerate(ABSTAINING) if code >> (len(LABELERS) + i) & 1}
    return [None if k in silent else code >> k & 1 for k in range(len(LABELERS))]


def _edge(x: Column) -> Column:
    """The kind of a neighbouring character: none, blank, digit, letter, quote, bracket, stop, other."""
    return (
        F.when(x == "", 0).when(x.rlike(r"\s"), 1).when(x.rlike("[0-9]"), 2).when(x.rlike(r"\p{L}"), 3)
        .when(x.rlike("[\"'=]"), 4).when(x.rlike(r"[()\[\]<>{}]"), 5).when(x.rlike("[.,;:!?]"), 6).otherwise(7)
    )


def _running(steps: Column) -> Column:
    """The sum of the steps before each, in blocks: linear up to millions of matches in a text."""
    block = 64
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda x, y: x + y)
    sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / block).cast("int")), lambda b: total(F.slice(steps, b * block + 1, block)))
    offsets = F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return F.transform(steps, lambda _, i: F.element_at(offsets, F.floor(i / block).cast("int") + 1) + total(F.slice(steps, F.floor(i / block).cast("int") * block + 1, i % block)))


def with_candidates(docs: DataFrame, text: Column) -> DataFrame:
    """Adds ``_candidates``: kind, start, end (code points), base, code of the votes and features.

    Matches are leftmost and do not overlap within a kind. Between them lie the pieces that a split by the same
    pattern gives, so places follow from the lengths of both.
    """
    out = docs.withColumn("_text", text)
    for kind in KINDS:
        pattern = F.lit(PATTERNS[kind])
        maybe = F.contains("_text", F.lit(NEEDS[kind])) if NEEDS[kind] else F.col("_text").rlike("[0-9]")
        none = F.array().cast("array<string>")
        out = out.withColumns({
            f"_hit_{kind}": F.when(maybe, F.regexp_extract_all("_text", pattern, 0)).otherwise(none),
        })
    for kind in KINDS:
        some = F.size(f"_hit_{kind}") > 0
        out = out.withColumn(f"_gap_{kind}", F.when(some, F.split("_text", PATTERNS[kind], -1)).otherwise(F.array().cast("array<string>")))
    for kind in KINDS:
        steps = F.zip_with(F.slice(f"_gap_{kind}", F.lit(1), F.size(f"_hit_{kind}")), f"_hit_{kind}", lambda gap, hit: F.length(gap) + F.length(hit))
        out = out.withColumn(f"_step_{kind}", steps)
    for kind in KINDS:
        some = F.size(f"_hit_{kind}") > 0
        out = out.withColumn(f"_at_{kind}", F.when(some, _running(F.col(f"_step_{kind}"))).otherwise(F.array().cast("array<int>")))

    def describe(kind: str, number: int):
        def candidate(hit: Column, i: Column) -> Column:
            gap, tail = F.element_at(f"_gap_{kind}", i + 1), F.element_at(f"_gap_{kind}", i + 2)
            before, after = F.right(gap, F.lit(CONTEXT + 1)), F.left(tail, F.lit(1))
            start = F.element_at(f"_at_{kind}", i + 1) + F.length(gap)
            code = votes_code(_votes(kind, hit, before, after))
            return F.struct(
                F.lit(number).alias("kind"), start.cast("int").alias("start"), (start + F.length(hit)).cast("int").alias("end"),
                base_valid(kind, hit).alias("base"), code.cast("int").alias("votes"),
                F.least(F.length(hit) / 3, F.lit(15)).cast("int").alias("size"),
                _edge(F.right(before, F.lit(1))).alias("before"), _edge(after).alias("after"),
            )
        return F.transform(f"_hit_{kind}", candidate)

    lists = [describe(kind, number) for number, kind in enumerate(KINDS)]
    helpers = [f"_{part}_{kind}" for kind in KINDS for part in ("hit", "gap", "step", "at")]
    return out.withColumn("_candidates", F.concat(*lists)).drop(*helpers)


@dataclass
class Model:
    """Log odds of the final classifier: a prior for each kind and a table for each kind and feature."""

    prior: list[float]
    odds: dict[str, list[list[float]]]
    reliability: dict[str, list[float]]

    def score(self, c: Column) -> Column:
        """Log odds that a candidate is personal data."""
        total = F.element_at(F.array(*map(F.lit, self.prior)), c["kind"] + 1)
        for name, values in FEATURES.items():
            flat = F.array(*[F.lit(x) for row in self.odds[name] for x in row])
            total = total + F.element_at(flat, c["kind"] * values + c[name] + 1)
        return total


def vote_counts(found: DataFrame) -> list[tuple[int, int, str, int, int]]:
    """How many candidates of all documents have each kind, votes and feature value: a table of fixed size."""
    c = F.col("c")
    values = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), c[name].alias("value")) for name in FEATURES]))
    rows = (
        found.select(F.explode("_candidates").alias("c")).select(c["kind"].alias("kind"), c["votes"].alias("votes"), values.alias("f"))
        .groupBy("kind", "votes", "f.name", "f.value").count().collect()
    )
    return sorted((r["kind"], r["votes"], r["name"], r["value"], r["count"]) for r in rows)


def fit(counts: list[tuple[int, int, str, int, int]]) -> Model:
    """Estimates how reliable each labeler is without labels, then fits the classifier to the outcome.

    For each kind, candidates are of one of three hidden classes (personal, alike, something else) in which labelers
    vote yes with unknown chances, independently; who abstains says nothing. Expectation and maximisation alternate, from
    the chances in ``EXPECTED``, which also count as ``WORTH`` votes each. The chances of the rule labeler stay beyond ``TIE``,
    as the other votes could else agree on some other class, such as that of all long numbers in running text; those
    have a class of their own, so that the many short numbers do not make them look personal.
    The chance of being personal that this gives to each pattern of votes is the soft label on which the classifier, a
    naive Bayes model on votes, size and neighbours, is trained. Kinds without candidates stay with what is expected.
    """
    prior, odds = [], {name: [] for name in FEATURES}
    reliability = {}
    for kind, name_of in enumerate(KINDS):
        own = [x for x in counts if x[0] == kind]
        patterns: dict[int, int] = defaultdict(int)
        for _, votes, name, _, n in own:
            if name == "votes":
                patterns[votes] += n
        shares, yes = [1 / 3] * 3, [EXPECTED[x] for x in LABELERS]
        chances = _chances(shares, yes)
        for _ in range(ROUNDS if patterns else 0):
            weights = [{v: n * chances[v][side] for v, n in patterns.items()} for side in range(3)]
            yes = [tuple(_rate(w, k, EXPECTED[x][side]) for side, w in enumerate(weights)) for k, x in enumerate(LABELERS)]
            yes[0] = (max(yes[0][0], TIE[0]), *(min(z, TIE[1]) for z in yes[0][1:]))
            shares = [(sum(w.values()) + SMOOTHING) / (sum(patterns.values()) + 3 * SMOOTHING) for w in weights]
            chances = _chances(shares, yes)
        belief = [min(max(c[0], 1e-12), 1 - 1e-12) for c in chances]
        others = [(shares[1] * z[1] + shares[2] * z[2]) / (shares[1] + shares[2]) for z in yes]
        reliability[name_of] = [y[0] / (y[0] + z) for y, z in zip(yes, others, strict=True)] if patterns else []
        prior.append(math.log(shares[0] / (1 - shares[0])))
        for name, values in FEATURES.items():
            # a cell that was never seen says what its votes do, or nothing
            table = [[belief[v], 1 - belief[v]] if name == "votes" else [SMOOTHING, SMOOTHING] for v in range(values)]
            for _, votes, own_name, value, n in own:
                if own_name == name:
                    table[value][0] += n * belief[votes]
                    table[value][1] += n * (1 - belief[votes])
            if name == "votes":
                # a pattern of votes counts in full: with the prior, the odds of its belief
                odds[name].append([math.log(cell[0] / cell[1]) - prior[-1] for cell in table])
            else:
                # what stands around it counts by a fraction
                totals = [sum(cell[i] for cell in table) for i in (0, 1)]
                odds[name].append([0.25 * math.log(cell[0] / totals[0] / (cell[1] / totals[1])) for cell in table])
    return Model(prior, odds, reliability)


def _chances(shares: list[float], yes: list[tuple[float, ...]]) -> list[list[float]]:
    """The chances of the classes, for each pattern of votes."""
    found = []
    for code in range(FEATURES["votes"]):
        both = list(zip(ballots(code), yes, strict=True))
        joint = [
            share * math.prod(y[side] if vote else 1 - y[side] for vote, y in both if vote is not None) for side, share in enumerate(shares)
        ]
        found.append([x / sum(joint) for x in joint])
    return found


def _rate(weights: dict[int, float], labeler: int, expected: float) -> float:
    """The share of yes among the votes that a labeler gives, with what is expected as ``WORTH`` votes."""
    votes = [(ballots(v)[labeler], n) for v, n in weights.items()]
    yes, all_ = (sum(n for vote, n in votes if vote), sum(n for vote, n in votes if vote is not None))
    return (yes + WORTH * expected) / (all_ + WORTH)


def spans(candidates: Column, model: Model) -> Column:
    """Base spans, and the others that the classifier takes, ordered by kind and start.

    An added span of a base kind is named after it with ``_like``: it has number of the kind plus 10.
    """
    taken = F.filter(candidates, lambda c: c["base"] | (model.score(c) > 0))
    named = F.transform(taken, lambda c: F.struct(
        F.when(c["base"] | (c["kind"] >= len(BASE_KINDS)), c["kind"]).otherwise(c["kind"] + 10).cast("int").alias("kind"),
        c["start"].cast("int").alias("start"), c["end"].cast("int").alias("end"),
    ))
    return F.array_sort(named)


def kind_name(kind: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.when(kind < 10, F.element_at(names, kind + 1)).otherwise(F.concat(F.element_at(names, F.greatest(kind - 9, F.lit(1))), F.lit("_like")))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", kind_name(s["kind"]), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` (an array of kind, start and end) of each document.

    Null texts count as empty and have none. Places are in code points of the whole text, ends exclusive. Equal
    rows have equal spans. The candidates are stored once, without texts.
    """
    narrow = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = materialize(with_candidates(narrow, F.col("text")).select("doc_id", "_candidates"))
    model = fit(vote_counts(found))
    return found.select("doc_id", spans(F.col("_candidates"), model).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns, each span of the text replaced by its kind in brackets.

    Spans that overlap become one, named after the first. The fit reads the texts once and stores the
    candidates, the replacement reads them once more; no text is shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # stored, as the optimizer would else find the candidates anew for each field that is counted
    model = fit(vote_counts(materialize(with_candidates(docs.select("text"), text).select("_candidates"))))
    packed = with_candidates(docs.select(F.struct("*").alias("_row"), F.col("text")), text)
    found = packed.withColumn("_spans", F.array_sort(F.transform(
        spans(F.col("_candidates"), model), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind_name(s["kind"]).alias("name")),
    ))).drop("_candidates")
    # the furthest end of the spans before each: a span that starts earlier continues one of them
    reach = F.aggregate(
        "_spans", F.array(F.lit(0)), lambda a, s: F.concat(a, F.array(F.greatest(F.element_at(a, -1), s["end"]))),
    )
    found = found.withColumn("_reach", F.when(F.size("_spans") > 0, reach))
    pieces = F.transform("_spans", lambda s, i: F.concat(
        # the text since the last end, then the name where a new span begins
        F.substring(F.col("_text"), F.element_at("_reach", i + 1) + 1, F.greatest(s["start"] - F.element_at("_reach", i + 1), F.lit(0))),
        F.when((s["start"] >= F.element_at("_reach", i + 1)), F.concat(F.lit("["), s["name"], F.lit("]"))).otherwise(F.lit("")),
    ))
    tail = F.substring(F.col("_text"), F.element_at("_reach", -1) + 1, F.length("_text"))
    new = F.when(F.size("_spans") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("_row.text"))
    found = found.withColumn("_new", new)
    return found.select(*[F.col("_new").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
