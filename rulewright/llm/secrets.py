"""Secrets in texts by patterns and by character Markov models, in DataFrame operations only.

Two first-order Markov models over the characters of a token, one of random strings and one of
ordinary identifiers, are counted from labelled samples with one added to each transition. Each transition has
the logarithm of the ratio of its two probabilities as its weight, in thousandths; a token's score is
the sum of its weights. Long tokens that no pattern explains, and that are likelier random by a wide
margin, join the spans that the patterns find. Texts are scanned where they are: only the counts of
transitions are shuffled, and the weights are a table of fixed size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulewright.llm.common import fresh

NAMES = ("password", "passwd", "secret", "token")
_EITHER = lambda word: "".join(f"[{c.upper()}{c}]" for c in word)
#: The patterns with what a match has to have at least. A run of hex digits, or of what follows AKIA, that is shorter has no longer one in it, so those two ask for the length at once.
ASSIGN = f"({'|'.join(map(_EITHER, NAMES))}|{_EITHER('api')}_?{_EITHER('key')})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_VALUE = 6
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
#: The characters of scored tokens; what a token has at least, and its score in thousandths of a nat.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN, SCORE = "[A-Za-z0-9+/_=-]{20,}", 12_000
#: Documents whose tokens the samples are made of, about.
SAMPLE_DOCS = 200
#: What stands for a token's begin; no character of the alphabet.
_BEGIN, _STATES = "^", len(ALPHABET) + 1


def _sampled(docs: DataFrame, doc_id: str, most: int) -> DataFrame:
    """About ``most`` documents, the same at each run: those whose hashed id is in the least part of the range."""
    rows = docs.count()
    bound = min(1 << 32, (most << 32) // max(rows, 1))
    return docs.filter(F.conv(F.substring(F.md5(F.col(doc_id).cast("string")), 1, 8), 16, 10).cast("long") < bound)


def labelled_samples(docs: DataFrame, most: int = SAMPLE_DOCS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct samples (sample, random) made of the tokens of about ``most`` documents.

    Ordinary ones are the tokens of 4 to 19 characters and what two neighbours make when joined
    as identifiers are (a_b, a-b, a/b, aB). Random ones are digests of the tokens, written as base 64 of both
    alphabets and as small and large hex digits. Rows without an id give none.
    """
    tokens = F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0)), lambda t: F.length(t) < 20)
    held = _sampled(docs, doc_id, most).select(tokens.alias("t"))
    after = F.slice("t", F.lit(2), F.size("t"))
    joined = [F.transform(F.arrays_zip(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))).alias("a"), after.alias("b")), f) for f in (
        lambda x: F.concat(x.a, F.lit("_"), x.b), lambda x: F.concat(x.a, F.lit("-"), x.b), lambda x: F.concat(x.a, F.lit("/"), x.b),
        lambda x: F.concat(x.a, F.upper(F.substring(x.b, 1, 1)), F.substring(x.b, 2, 20)),
    )]
    plain = held.select(F.explode(F.concat("t", *joined)).alias("sample")).distinct()
    digest = held.select(F.explode("t").alias("t")).distinct().select(F.sha2("t", 256).alias("d"))
    random = digest.select(F.explode(F.array(F.base64(F.unhex("d")), F.translate(F.base64(F.unhex("d")), "+/", "-_"), "d", F.upper("d"))).alias("sample"))
    return plain.withColumn("random", F.lit(False)).unionByName(random.withColumn("random", F.lit(True)))


def fitted(samples: DataFrame) -> list[int]:
    """The weight of each transition in thousandths, by 68 * state + next; state 0 is a token's begin.

    Each sample counts as often as it stands there. Characters outside the alphabet break the chain: transitions from or to
    them aren't counted. Without samples all weights are 0.
    """
    places = samples.filter(F.length("sample") > 0).select("random", F.concat(F.lit(_BEGIN), "sample").alias("s"), F.explode(F.sequence(F.lit(1), F.length("sample"))).alias("i"))
    pairs = places.select("random", F.substr("s", F.col("i"), F.lit(2)).alias("pair"))
    each = pairs.groupBy("pair").agg(*[F.count(F.when(F.col("random") == kind, 1)).alias(n) for n, kind in (("r", True), ("o", False))])
    code = lambda c: F.instr(F.lit(_BEGIN + ALPHABET), c) - 1
    counts = each.select(code(F.substring("pair", 1, 1)).alias("state"), code(F.substring("pair", 2, 1)).alias("next"), "r", "o").filter("state >= 0 AND next > 0")
    # one row for each state: its totals and the transitions that were seen
    states = counts.groupBy("state").agg(F.sum("r").alias("rs"), F.sum("o").alias("os"), F.map_from_entries(F.collect_list(F.struct("next", F.struct("r", "o")))).alias("seen"))
    share = lambda n, total: (F.coalesce(n, F.lit(0)) + 1) / (F.col(total) + len(ALPHABET))
    weight = lambda x: F.round(1000 * (F.log(share(x["r"], "rs")) - F.log(share(x["o"], "os")))).cast("int")
    rows = states.select("state", F.transform(F.sequence(F.lit(0), F.lit(len(ALPHABET))), lambda c: weight(F.try_element_at("seen", c))).alias("w")).collect()
    found = {r.state: r.w for r in rows}
    return [w for state in range(_STATES) for w in found.get(state, [0] * _STATES)]


def score(token: Column, weights: list[int]) -> Column:
    """The log-likelihood ratio of a token in thousandths of a nat, above 0 if it is likelier random; characters outside the alphabet count 0."""
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    place = lambda i: F.when(i > 0, F.nullif(F.instr(F.lit(ALPHABET), F.substr(token, i, F.lit(1))), F.lit(0))).otherwise(0)
    step = lambda i: F.coalesce(F.get(table, place(i - 1) * _STATES + place(i)), F.lit(0))
    return F.when(F.length(token) > 0, F.aggregate(F.sequence(F.lit(1), F.length(token)), F.lit(0), lambda total, i: total + step(i))).otherwise(0)


def _located(text: str, matches: str, parts: str) -> Column:
    """(start, end, match) of each match of a pattern, from the matches and what stands between them; in code points, end exclusive."""
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(held: Column, i: Column) -> Column:
        match = F.get(matches, i)
        start = held["at"] + F.length(F.get(parts, i))
        end = start + F.length(match)
        return F.struct(end.alias("at"), F.concat(held["found"], F.array(F.struct(start.alias("start"), end.alias("end"), match.alias("match")))).alias("found"))

    return F.when(F.size(matches) > 0, F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), begin, step, lambda held: held["found"])).otherwise(none)


def find_secrets(docs: DataFrame, weights: list[int], text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with a column ``spans``: an array of (start, kind, end), sorted by start and the order of kinds.

    Kinds are assign (a name such as ``password``, in letters of either case, a colon or equals sign and a value of 6
    characters or more), access (AKIA and 16 capitals or digits or more), hex (24 small hex digits or more),
    each leftmost and without overlaps among its kind, and random: runs of 20 or more characters
    of the alphabet that hold a letter and a digit, overlap no other kind and score SCORE or more by ``weights``
    of ``fitted``. Starts and ends count code points, end exclusive.

    Each row is looked at by itself, so repeated rows and null ids don't matter. Null and empty texts have no
    spans; texts are scanned whole at any length (finding the places takes time that grows with the square of one
    text's matches). All other columns stay; a ValueError is raised if there is one named ``spans``.
    """
    if fresh(docs, spans) != spans:
        raise ValueError(f"docs has a column {spans} already")
    names = {kind: [fresh(docs, f"secrets_{kind}_{x}") for x in ("matches", "parts", "spans")] for kind in KINDS}
    whole, base = fresh(docs, "secrets_text"), fresh(docs, "secrets_base")
    out = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, TOKEN), strict=True))
    out = out.withColumns({names[k][0]: F.regexp_extract_all(whole, F.lit(p), F.lit(0)) for k, p in patterns.items()})
    out = out.withColumns({names[k][1]: F.when(F.size(names[k][0]) > 0, F.split(whole, p, -1)) for k, p in patterns.items()})
    out = out.withColumns({names[k][2]: _located(whole, *names[k][:2]) for k in KINDS})
    value = lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= ASSIGN_VALUE
    spanned = lambda k, found: F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(k)).alias("kind"), x["end"].alias("end")))
    out = out.withColumn(base, F.concat(spanned("assign", F.filter(names["assign"][2], value)), *[spanned(k, F.col(names[k][2])) for k in ("access", "hex")]))

    def stands_out(x: Column) -> Column:
        apart = ~F.exists(base, lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
        return F.regexp_like(x["match"], F.lit("[0-9]")) & F.regexp_like(x["match"], F.lit("[A-Za-z]")) & apart & (score(x["match"], weights) >= SCORE)

    every = F.array_sort(F.concat(base, spanned("random", F.filter(names["random"][2], stands_out))))
    label = lambda kind: F.get(F.array(*[F.lit(k) for k in KINDS]), kind)
    named = F.transform(every, lambda s: F.struct(s["start"].alias("start"), label(s["kind"]).alias("kind"), s["end"].alias("end")))
    return out.withColumn(spans, named).select(*docs.columns, spans)


def mask_secrets(docs: DataFrame, weights: list[int], text: str = "text") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by its kind in angle brackets; overlapping spans by the first one's. Null texts stay null."""
    spans = fresh(docs, "spans")
    found = find_secrets(docs, weights, text, spans)
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    between = lambda held, end: F.substr(F.col(text), held["at"] + 1, end - held["at"])

    def step(held: Column, s: Column) -> Column:
        added = F.concat(held["out"], between(held, s["start"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(F.greatest(held["at"], s["end"]).alias("at"), F.when(s["start"] >= held["at"], added).otherwise(held["out"]).alias("out"))

    masked = F.aggregate(spans, begin, step, lambda held: F.concat(held["out"], between(held, F.length(text))))
    return found.withColumn(text, F.when(F.size(spans) > 0, masked).otherwise(F.col(text))).drop(spans)


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(*kinds: str) -> Callable[[Column], Column]:
    """Whether a span is of one of these kinds."""
    return lambda span: span["kind"].isin(*kinds)
