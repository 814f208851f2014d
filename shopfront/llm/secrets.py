"""Operator 4: secret scan with a trigram inverted index (DataFrame functions only).

For each rule a Boolean query over trigrams is derived from its regular
expression: every match must hold, for some alternative of each clause, all its
trigrams.  Postings (trigram, document) are built for the trigrams that the
rules use, over the lower-cased whole texts; the queries intersect and unite
them per document (a bit-or of partial masks, so a trigram that every document
holds is spread by document).  Only candidates are verified with the regular
expression; rules without mandatory trigrams scan every text.

Defined results: null text counts as empty; a null doc_id has no posting and is
scanned fully by every rule; rows that share a doc_id share their candidates,
but each text is verified itself; an empty table gives an empty table; extra
columns are ignored by ``find_secrets`` and kept by ``redact``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, packed


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1  # matches whose group is shorter are dropped


# A private key runs from its BEGIN line to its END line, with no other line of five dashes between.  Without such an
# END line it takes armour headers with a blank line, then lines of 76, 70 and 64 base64 characters, then lines that hold
# base64 only, then runs of 25 after blanks; none of them has a bound.  Repeats of variable groups are possessive
# (``*+``), which Java matches in a loop and not by recursion; as nothing that follows them can match what a round
# took, the same pattern with plain repeats (``plain``) finds the same spans.
_BASE64 = "[A-Za-z0-9+/]"
_ARMOUR = r"PRIVATE KEY(?: BLOCK)?-----"
_LINE = r"\r?\n[\x20\t>]*"
PEM = (rf"-----BEGIN [A-Z ]{{0,40}}{_ARMOUR}(?:"
       rf"[^-]*(?:-{{1,4}}[^-]+)*+-----END [A-Z ]{{0,40}}{_ARMOUR}|"
       rf"(?:(?:{_LINE}[A-Za-z][A-Za-z0-9-]*:[^\r\n]*)++{_LINE}{_LINE}{_BASE64}{{25,}}=*)?"
       + "".join(rf"(?:{end}{_BASE64}{{{n}}})*" for end in (r"\s", r"\r\n", r"\\n") for n in (76, 70, 64))
       + rf"{_BASE64}*=*"
       rf"(?:{_LINE}=?{_BASE64}+=*[\x20\t]*(?:\r|(?m:$))|(?:\\r)?\\n{_BASE64}+=*)*+"
       rf"(?:[\s>]*(?:\\r)?(?:\\n)?{_BASE64}{{25,}}=*)*+)")


def plain(pattern: str) -> str:
    """``pattern`` for engines without possessive repeats (RE2)."""
    return pattern.replace("*+", "*").replace("++", "+")


# Fixed values of the contract, then this operator's own rules, in the order in which kinds are listed.  A length
# bound is inside the pattern where that finds the same spans: greedy runs that no failing match can hide.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", PEM),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
BASE = ("assign", "access", "hex")
MOST = 64  # strings that one run of a pattern may stand for


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Clauses (all must hold) of alternatives (one must hold) of trigrams (all must occur), lower-cased.

    Runs of the pattern that stand for few strings give a clause; classes and
    open repeats end a run.  No clause: the rule has no mandatory trigram.
    """
    from re import _constants as C
    from re import _parser as P
    clauses: list[list[frozenset[str]]] = []

    def strings(item) -> set[str] | None:
        """All strings that an item stands for, or None."""
        op, arg = item
        if op is C.LITERAL:
            return {chr(arg).lower()}
        if op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 8:
            return {chr(a).lower() for _, a in arg}
        if op is C.SUBPATTERN:
            return joined(arg[-1])
        if op is C.BRANCH:
            parts = [joined(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if op is C.MAX_REPEAT and arg[1] is not C.MAXREPEAT and int(arg[1]) <= 8:
            one = joined(arg[2])
            if one is None:
                return None
            out, last = set(), {""}
            for k in range(int(arg[1]) + 1):
                out |= last if k >= arg[0] else set()
                last = {a + b for a in last for b in one}
                if len(out) + len(last) > MOST:
                    return None
            return out
        return None

    def joined(seq) -> set[str] | None:
        run = {""}
        for item in seq:
            got = strings(item)
            if got is None or len(run) * len(got) > MOST:
                return None
            run = {a + b for a in run for b in got}
        return run

    def close(run: set[str]) -> None:
        if all(len(s) >= 3 for s in run):
            options = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run}
            clauses.append(sorted((o for o in options if not any(p < o for p in options)), key=sorted))

    def walk(seq) -> None:
        run = {""}
        for item in seq:
            got = strings(item)
            if got is not None and len(run) * len(got) <= MOST:
                run = {a + b for a in run for b in got}
                continue
            close(run)
            run = got if got is not None else {""}
            if got is None and item[0] is C.SUBPATTERN:
                walk(item[1][-1])
            elif got is None and item[0] is C.MAX_REPEAT and item[1][0] > 0:
                walk(item[1][2])
        close(run)

    walk(P.parse(pattern))
    return clauses


WORD = 62  # trigrams a mask column
FEW = 100_000  # candidates that are broadcast: under 10 MB


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """(doc_id, one boolean a rule): the rules whose trigram query a document satisfies.

    Documents that satisfy no query have no row.  Rules without a query have no column.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in queries.values() for c in q for o in c for g in o})
    low = F.lower(F.coalesce("text", F.lit("")))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("_low"), F.lit(g)), F.lit(i))
                                     for i, g in enumerate(grams)])) if grams else F.array().cast("array<int>")
    postings = (docs.filter("doc_id is not null").select("doc_id", low.alias("_low"))
                .select("doc_id", F.explode(held).alias("gram")))
    words = range(-(-len(grams) // WORD))
    bit = lambda w: F.when(F.floor(F.col("gram") / WORD) == w, F.expr(f"shiftleft(1L, gram - {w * WORD})"))
    masks = postings.groupBy("doc_id").agg(*[F.coalesce(F.bit_or(bit(w)), F.lit(0)).alias(f"m{w}") for w in words],
                                           F.count("*").alias("_n"))

    def holds(option: frozenset[str]) -> Column:
        out = F.lit(True)
        for w in words:
            need = sum(1 << (i - w * WORD) for i, g in enumerate(grams) if g in option and i // WORD == w)
            if need:
                out = out & (F.col(f"m{w}").bitwiseAND(F.lit(need)) == need)
        return out

    def query(q) -> Column:
        out = F.lit(True)
        for clause in q:
            some = F.lit(False)
            for option in clause:
                some = some | holds(option)
            out = out & some
        return out

    flags = [query(q).alias(f"_c_{kind}") for kind, q in queries.items()]
    return masks.select("doc_id", *flags).filter(reduce(Column.__or__, [query(q) for q in queries.values()], F.lit(False)))


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, end>> of a rule's matches: code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    between = F.split(text, rule.pattern, -1)
    steps = F.zip_with(F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(
        F.length(b).cast("long").alias("gap"), F.length(m).cast("long").alias("n"))), counted, lambda s, c: F.struct(
            s["gap"].alias("gap"), s["n"].alias("n"), F.length(c).alias("own")))
    span = "struct<start:bigint,rank:int,end:bigint,own:int>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{span}>").alias("out"))

    def step(acc, s):
        at = acc["at"] + s["gap"]
        return F.struct((at + s["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(
            at.alias("start"), F.lit(rank).alias("rank"), (at + s["n"]).alias("end"),
            s["own"].alias("own")).cast(span))).alias("out"))

    all_ = F.aggregate(steps, start, step, lambda acc: acc["out"])
    return F.transform(F.filter(all_, lambda s: s["own"] >= rule.least),
                       lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))


def with_spans(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with ``_spans``: all verified matches, by start, then the rule's place in ``rules``.

    The candidates are computed first.  Up to FEW of them (an id and a flag a
    rule each) go to the texts by broadcast; more are joined by doc_id.
    """
    got = cut(candidates(docs, rules))
    flags = [c for c in got.columns if c != "doc_id"]
    found = docs.join(F.broadcast(got) if got.count() <= FEW else got, "doc_id", "left").withColumn("_text", F.coalesce("text", F.lit("")))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    parts = []
    for rank, rule in enumerate(rules):
        spans = spans_of(F.col("_text"), rule, rank)
        flag = f"_c_{rule.kind}"
        parts.append(F.when(F.col("doc_id").isNull() | F.coalesce(flag, F.lit(False)), spans).otherwise(none)
                     if flag in flags else spans)
    return found.withColumn("_spans", F.array_sort(F.concat(*parts))).drop("_text", *flags)


def _listed(spans: Column, rules) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def find_secrets(docs: DataFrame, rules=RULES, base=BASE) -> DataFrame:
    """Per document: counts of the base kinds, digest of the base spans, and all spans as kind:start:end."""
    n = len(base)  # the base kinds come first in ``rules``
    spans = F.col("_spans")
    of = lambda k: F.filter(spans, lambda s: s["rank"] == k)
    counts = [F.size(of(k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(base)]
    return with_spans(docs.select("doc_id", "text"), rules).select(
        "doc_id", *counts, F.sha2(_listed(F.filter(spans, lambda s: s["rank"] < n), rules), 256).alias("base_sha256"),
        _listed(spans, rules).alias("spans"))


def redact(docs: DataFrame, rules=RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by ``mark`` (overlapping spans by one mark).

    A column ``n_chars`` follows the new text; texts without secrets stay as they are.
    """
    text = F.col("text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.when(s["start"] >= acc["at"], F.concat(
            F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    cleaned = F.aggregate(F.col("_spans"), start, step, lambda acc: F.concat(
        acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.length(text))))
    hit = F.size("_spans") > 0
    found = (with_spans(packed(docs), rules)
             .select("_row", "_spans", F.when(hit, cleaned).otherwise(text).alias("_new")))
    own = {"text": F.col("_new"), "n_chars": F.when(hit, F.length("_new")).otherwise(F.col("_row").getField("n_chars"))}
    return found.select(*[(own[f.name].cast(f.dataType) if f.name in own else F.col("_row").getField(f.name)).alias(f.name)
                          for f in docs.schema])
