"""Personal data: base patterns, and candidates chosen by boosted trees. DataFrame functions only.

Base spans (email, ip, card, phone) follow fixed patterns and checks. Beside them, generators of high recall propose
further, overlapping candidates: assigned values, opaque strings, spelt-out email addresses, long numbers and
phone numbers, with a country's code where the base pattern has taken in too much, and without one. Gradient-boosted trees score each candidate by its format and its
context; for every kind of candidate a calibrated threshold selects redactions. Of selected candidates that overlap, the best one stands.

Nobody has labelled such candidates, so the trees learn from positives and unlabelled ones. A positive's label comes from
a view that the features don't see:

- disguised twins of verified base spans: an email address spelt out, a card number without its separators (and, every
  other one, with a wrong last digit), a phone number without its "+" and country, and one as it is, for numbers of that form
  that run on into other digits. They stand in their real context.
- values that are assigned to a secret's name. Neither the name nor whether there is one is a feature, so what is learned is what secrets
  look like; the same value without its name is a twin of kind ``opaque``.

All other candidates are unlabelled: personal or not. Trained so, a score is in proportion to the chance to be personal,
and the mean score of held-out positives tells by which factor; a kind's threshold is half of that mean, where
a candidate is as likely personal as not (Elkan and Noto's calibration).

The trees and the thresholds come from all candidates of all documents. Features go in steps (lengths, and shares in ``STEPS`` parts), so that
candidates that look the same are counted together: what is fitted are these cells, weighted by their candidates, which is the same as fitting
the candidates. There are as many cells as there are forms, far fewer than candidates. Scoring is a Column of nested conditions inside the row: no shuffle, no
Python. Every pattern is written so that a search takes time in proportion to the text: repetitions are possessive
where giving back can't help, and a run of letters or digits is entered only at its start or where the last
match ended.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, stored

# The base kinds in their order, and their patterns (see the docstring for the possessive form).
BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold (one of them) before a pattern is tried.
NEEDS = {"email": ["@"], "phone": ["+"], "plus_phone": ["+"], "secret": ["=", ":"], "spelt_email": [" at ", "(at)", "[at]"]}
NAME, ASSIGN = r"(?<![A-Za-z0-9_-])[A-Za-z_][A-Za-z0-9_-]*+", r"[\x22']?\x20?[=:]\x20?[\x22']?"
CANDIDATE_PATTERNS = {
    "secret": NAME + ASSIGN + r"[A-Za-z0-9_/+=.-]{8,}+",
    "opaque": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{16,}+={0,2}",
    "spelt_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:(?:\x20dot\x20|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9._%+-]++)*+(?:\x20at\x20|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\x20dot\x20|\x20?[(\[]dot[)\]]\x20?|\.)[A-Za-z0-9-]++)++",
    "number": r"(?<![0-9A-Za-z.+-])[0-9]{7,}+(?![A-Za-z])",
    "plus_phone": r"\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])",
    "local_phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z-])",
}
# Words in the names that secrets are assigned to.
SECRET_NAMES = r"(?i)^[a-z0-9_-]*?(?:token|secret|passw|passphrase|pwd|credential|(?:^|[_-]|api|access|private|auth|client)key)"
ORDER = [*BASE_PATTERNS, *CANDIDATE_PATTERNS]
#: Parts of a share that features tell apart, and the length up to which they tell each one (beyond, quarters of a power of two).
STEPS, LENGTHS = 16, 64
TREES, DEPTH = 12, 3
FEATURES = ["length", "digits", "letters", "uppers", "marks", "variety", "hexadecimal", "luhn", "turns", "mail_before", "phone_before", "card_before", "digit_before", "digit_after", "letter_after", *(f"is_{x}" for x in CANDIDATE_PATTERNS)]
#: Characters of context before and after a candidate.
BEFORE, AFTER = 24, 4


def spans(text: Column, pattern: str, needs: list[str] | None = None) -> Column:
    """array<struct<start,end,value>> of the leftmost non-overlapping matches, in code points.

    What lies between the matches (``split``) tells where they start.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    pairs = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(values)).alias("gap"), values.alias("value")), lambda x: F.struct(F.length(x["gap"]).alias("gap"), x["value"].alias("value")))

    def add(done: Column, pair: Column) -> Column:
        start = done["at"] + pair["gap"]
        end = start + F.length(pair["value"])
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value")))).alias("out"))

    found = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda x: x["out"])
    tried = F.when(F.size(values) > 0, found).otherwise(empty)
    return tried if needs is None else F.when(reduce(lambda a, b: a | b, [F.instr(text, x) > 0 for x in needs]), tried).otherwise(empty)


def valid(kind: str, value: Column) -> Column:
    """The check of a base kind."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        digits = F.regexp_replace(value, r"[\x20-]", "")
        return F.when(F.length(digits).between(13, 19), F.call_function("luhn_check", digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(spans(text, BASE_PATTERNS[kind], NEEDS.get(kind)), lambda x: valid(kind, x["value"]))


def described(kind: str, text: Column, x: Column, value: Column | None = None) -> Column:
    """A candidate: its kind, place and value with the context around it."""
    before = F.lower(F.substring(text, F.greatest(x["start"] - (BEFORE - 1), F.lit(1)), F.least(x["start"], F.lit(BEFORE))))
    return F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), (x["value"] if value is None else value).alias("value"), before.alias("before"), F.substring(text, x["end"] + 1, F.lit(AFTER)).alias("after"))


def candidates(text: Column) -> Column:
    """array<struct<kind,start,end,value,before,after>> of all generators."""

    def of(kind: str) -> Column:
        return F.transform(spans(text, CANDIDATE_PATTERNS[kind], NEEDS.get(kind)), lambda x: described(kind, text, x))

    return F.concat(*map(of, CANDIDATE_PATTERNS))


def named(value: Column) -> Column:
    """Whether the name in an assignment is a secret's."""
    return F.regexp_extract(value, "^" + NAME, 0).rlike(SECRET_NAMES)


def format_value(x: Column) -> Column:
    """What the features look at: of an assignment the value alone, so that its name stays unseen."""
    return F.when(x["kind"] == "secret", F.regexp_replace(x["value"], "^" + NAME + ASSIGN, "")).otherwise(x["value"])


def twins(text: Column) -> Column:
    """Disguised twins of base spans, and secrets without their names: candidates that are known to be personal."""

    def of(kind: str, found: Column, value) -> Column:  # noqa: ANN001
        made = F.transform(found, lambda x: described(kind, text, x, value(x)))
        return F.filter(made, lambda x: x["value"].rlike(f"^(?:{CANDIDATE_PATTERNS[kind]})$"))

    spelt = lambda x: F.concat(F.substring_index(x["value"], "@", 1), F.lit(" at "), F.replace(F.substring_index(x["value"], "@", -1), F.lit("."), F.lit(" dot ")))
    digits = lambda x: F.regexp_replace(x["value"], "[^0-9]", "")
    last = lambda d: F.substring(d, -1, 1).cast("int")
    wrong = lambda d: F.concat(F.substring(d, F.lit(1), F.length(d) - 1), ((last(d) + 1 + F.pmod(F.xxhash64(d), F.lit(8)).cast("int")) % 10).cast("string"))
    number = lambda x: F.when(F.pmod(F.xxhash64(x["value"], F.lit(1)), F.lit(2)) == 0, digits(x)).otherwise(wrong(digits(x)))
    local = lambda x: F.regexp_replace(x["value"], r"^\+[0-9]{1,3}[\x20.-]?", "")
    secrets = F.filter(spans(text, CANDIDATE_PATTERNS["secret"], NEEDS["secret"]), lambda x: named(x["value"]))
    bare = lambda x: F.regexp_replace(x["value"], "^" + NAME + ASSIGN, "")
    return F.concat(of("spelt_email", base_spans(text, "email"), spelt), of("number", base_spans(text, "card"), number), of("local_phone", base_spans(text, "phone"), local), of("plus_phone", base_spans(text, "phone"), lambda x: x["value"]), of("opaque", secrets, bare))


def count_of(value: Column, letters: str) -> Column:
    return F.length(value) - F.length(F.regexp_replace(value, letters, ""))


def features(x: Column) -> dict[str, Column]:
    """Format and context of a candidate (with ``shown``, see ``format_value``), as doubles that take few values."""
    value, before, after = x["shown"], x["before"], x["after"]
    size = F.greatest(F.length(value), F.lit(1))
    stepped = lambda part: F.round(part * STEPS) / STEPS
    share = lambda letters: stepped(count_of(value, letters) / size)
    long = F.pow(F.lit(2.0), F.floor(F.log2(size) * 4) / 4)
    flag = lambda c: c.cast("double")
    digits = F.regexp_replace(value, "[^0-9]", "")
    whole = x["kind"] != "plus_phone"  # a "+" begins a number, and the form ends it: digits beside it are another one's
    out = {
        "length": F.when(size <= LENGTHS, flag(F.length(value))).otherwise(long), "digits": share("[0-9]"), "letters": share("[A-Za-z]"), "uppers": share("[A-Z]"), "marks": share("[^0-9A-Za-z]"),
        "variety": stepped(F.size(F.array_distinct(F.split(F.substring(value, 1, 64), ""))) / F.least(size, F.lit(64))), "hexadecimal": flag(value.rlike("^[0-9a-fA-F]+$")),
        "luhn": flag(F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)), "turns": stepped(count_of(F.regexp_replace(value, "[0-9]+", "0"), "0") / size),
        "mail_before": flag(before.rlike(r"(?:mail|contact|reach|write)[^a-z]*$")), "phone_before": flag(before.rlike(r"(?:phone|call|tel|mobile|fax)[^a-z]*$")),
        "card_before": flag(before.rlike(r"(?:card|visa|account|iban|number)[^a-z]*$")), "digit_before": flag(before.rlike("[0-9][ .,-]?$") & whole),
        "digit_after": flag(after.rlike("^[ .,-]?[0-9]") & whole), "letter_after": flag(after.rlike("^[ ,]?[A-Za-z]")),
    }
    return out | {f"is_{k}": flag(x["kind"] == k) for k in CANDIDATE_PATTERNS}


def tree_column(lines: list[str], x: dict[str, Column]) -> Column:
    """A fitted tree as nested conditions, from its description: pairs of "If (feature 3 <= 0.5)" and "Else", and
    "Predict: 0.25". Takes the lines off the list that it has read."""
    line = lines.pop(0)
    if line.startswith("Predict"):
        return F.lit(float(line.split(":")[1]))
    feature, limit = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
    low = tree_column(lines, x)
    lines.pop(0)
    return F.when(x[FEATURES[int(feature)]] <= float(limit), low).otherwise(tree_column(lines, x))


class Selector:
    """Fitted trees (weight and description) and a threshold for each kind of candidate (above 1: the kind is never selected)."""

    def __init__(self, trees: list[tuple[float, str]], thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, x: dict[str, Column]) -> Column:
        """Of a candidate with these features."""
        if not self.trees:
            return F.lit(0.0)
        margin = reduce(lambda a, b: a + b, [F.lit(w) * tree_column(text.split("\n"), x) for w, text in self.trees])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))

    def scored(self, found: Column) -> Column:
        """The candidates of an array with ``score``; the features are worked out once for each and bound."""
        shown = F.transform(found, lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "start", "end", "value", "before", "after")), format_value(x).alias("shown")))
        with_features = F.transform(shown, lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "start", "end", "value")), F.struct(*(c.alias(n) for n, c in features(x).items())).alias("f")))
        return F.transform(with_features, lambda x: F.struct(*(x[c].alias(c) for c in ("kind", "start", "end", "value")), self.score({n: x["f"][n] for n in FEATURES}).alias("score")))

    def chosen(self, x: Column) -> Column:
        limit = reduce(lambda rest, k: F.when(x["kind"] == k, F.lit(self.thresholds[k])).otherwise(rest), self.thresholds, F.lit(2.0))
        return x["score"] >= limit


def best_of_overlapping(found: Column) -> Column:
    """Selected candidates from left to right; of two that overlap the one with the higher score stands, of equal ones the
    longer, then the earlier one."""
    better = lambda a, b: (a["score"] > b["score"]) | ((a["score"] == b["score"]) & (a["end"] - a["start"] > b["end"] - b["start"]))

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        return F.when((F.size(done) == 0) | (F.get(done, F.size(done) - 1)["end"] <= x["start"]), F.concat(done, F.array(x))).when(better(x, last), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(x))).otherwise(done)

    ordered = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value"), x["score"].alias("score"))))
    return F.aggregate(ordered, F.array().cast("array<struct<start:int,end:int,kind:string,value:string,score:double>>"), add)


def overlaps_base(x: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.exists(F.col(k), lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])) for k in BASE_PATTERNS])


def training_rows(docs: DataFrame, sample: int | None = None, n_docs: int | None = None) -> DataFrame:
    """kind, positive, held_out and the features of every candidate and twin. ``fit`` takes them all; who asks for fewer gets at most ``sample``, those
    with the smallest hashes, or those of about ``n_docs`` documents, chosen by hash too."""
    text = F.col("text")
    rows = documents(docs)
    if n_docs is not None:
        share = n_docs / max(n_docs, docs.count())
        rows = rows.where(F.pmod(F.xxhash64("doc_id", text, F.lit(9)), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30))))
    rows = rows.select("doc_id", text, *(base_spans(text, k).alias(k) for k in BASE_PATTERNS))

    def marked(found: Column, positive) -> Column:  # noqa: ANN001
        fields = lambda x: [x[c].alias(c) for c in ("kind", "start", "end", "value", "before", "after")]
        return F.transform(found, lambda x: F.struct(F.xxhash64("doc_id", x["start"], x["kind"], positive(x)).alias("h"), positive(x).alias("positive"), *fields(x)))

    plain = marked(F.filter(candidates(text), lambda x: ~overlaps_base(x)), lambda x: (x["kind"] == "secret") & named(x["value"]))
    # Flat columns: fields taken out of an exploded struct would each evaluate the generators anew.
    found = rows.select(F.inline(F.concat(plain, marked(twins(text), lambda x: F.lit(True)))))
    if sample is not None:
        found = found.orderBy("h", "start", "end", "value").limit(sample)
    x = {c: F.col(c) for c in ("kind", "value", "before", "after")}
    shown = features(x | {"shown": format_value(x)})
    return found.select("kind", F.col("positive").cast("double").alias("label"), (F.pmod("h", F.lit(3)) == 0).alias("held_out"), *(c.alias(n) for n, c in shown.items()))


def cells(rows: DataFrame) -> DataFrame:
    """``training_rows`` that are the same in all columns as one, and ``n`` (double), how many there are."""
    return rows.groupBy(*rows.columns).agg(F.count("*").cast("double").alias("n"))


def fit(docs: DataFrame) -> Selector:
    """Trees from two thirds of ``training_rows``, thresholds from the rest. A kind of which no positive is held out is never
    selected; without positives, or with nothing else, nothing is."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    held = stored(cells(training_rows(docs)), "candidates")
    if held.where(~F.col("held_out")).select("label").distinct().count() < 2:
        return Selector([], {})
    n_cells = held.count()
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(held.coalesce(2 + n_cells // 100_000))
    # Spark looks for the limits between values in 10,000 rows, or in the square of maxBins if that is more: so in all cells.
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=max(2 * LENGTHS, math.isqrt(n_cells) + 1), weightCol="n", seed=7).fit(ready.where(~F.col("held_out")))
    trees = [(float(w), "\n".join(x.strip() for x in t.toDebugString.split("\n")[1:] if x.strip())) for w, t in zip(model.treeWeights, model.trees, strict=True)]
    means = model.transform(ready.where("held_out and label = 1")).groupBy("kind").agg((F.sum(_second("probability") * F.col("n")) / F.sum("n")).alias("p")).collect()  # a row for each kind
    return Selector(trees, dict.fromkeys(CANDIDATE_PATTERNS, 2.0) | {r.kind: r.p / 2 for r in means})


def _second(vector: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return F.element_at(vector_to_array(F.col(vector)), 2)


def detect(docs: DataFrame, selector: Selector | None = None, *keep: str) -> DataFrame:
    """One row per row of docs: doc_id, ``keep`` (of text), base spans by kind (arrays email, ip, card, phone), and ``more``: the
    selected candidates that no base span overlaps (start, end, kind, value, score), from left to right and disjoint.

    Null and empty texts have no spans; a repeated row, or another one of the same doc_id, is searched for itself; candidates of
    the same kind are the leftmost ones that don't overlap."""
    selector = selector or fit(docs)
    text = F.col("text")
    rows = documents(docs).select("doc_id", text, *(base_spans(text, k).alias(k) for k in BASE_PATTERNS))
    free = F.filter(candidates(text), lambda x: ~overlaps_base(x))
    return rows.select("doc_id", *keep, *BASE_PATTERNS, best_of_overlapping(F.filter(selector.scored(free), selector.chosen)).alias("more"))


def redact(docs: DataFrame, selector: Selector | None = None) -> DataFrame:
    """(doc_id, text) for each row of docs, with every found span written as its kind in angle brackets; of base spans that
    overlap only the first is written, over the bytes of all of them."""
    text, at = F.col("text"), F.col("spans")
    plain = lambda k, c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(k).alias("kind")))
    every = F.array_sort(F.concat(*(plain(k, F.col(k)) for k in BASE_PATTERNS), F.transform("more", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))))
    found = detect(docs, selector, "text").select("doc_id", "text", every.alias("spans"))
    step = lambda done, x: F.struct(F.greatest(done["at"], x["end"]).alias("at"), F.when(x["start"] < done["at"], done["out"]).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, x["start"] - done["at"]), F.lit("<"), x["kind"], F.lit(">"))).alias("out"))
    return found.select("doc_id", F.aggregate(at, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda d: F.concat(d["out"], F.substring(text, d["at"] + 1, F.length(text)))).alias("text"))


def of_kind(column: str, kind: str) -> Column:
    return F.filter(column, lambda x: x["kind"] == kind)


def listed(kind: str, column: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.transform(column, lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))
