"""Personal data by weak supervision.

Regex, gazetteer and context labelers vote on candidate spans; expectation
maximisation estimates each labeler's reliability from the counts of all vote
patterns; a logistic span classifier, trained on its soft labels but seeing the
words around a span and its shape, decides. Family names are learned from the
table: those that often follow a title or a known given name.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_binary, small, smallest, stage_table
from .spans import Span, digest, find_rows, in_code_points, joined
from .textops import Words, text_slices

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("masked_email", "national_phone", "ssn", "iban", "name")
LABELERS = ("form", "checksum", "gazetteer", "cue", "counter_cue", "shape", "learned")
#: Hashed words around a span, and buckets of its length and digits, that the classifier sees.
CONTEXT, SHAPES = 96, 24
#: Candidates, those with the smallest hashes, that the classifier is fitted on.
MAX_FIT = 20_000
_LOCAL = re.compile(rb"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_MASKED = re.compile(rb"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]++)+")
_NATIONAL = re.compile(rb"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9.-])")
_SSN = re.compile(rb"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(rb"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Latin letters with and without marks, as UTF-8.
_BIG, _SMALL = rb"(?:[A-Z]|\xc3[\x80-\x9e])", rb"(?:[a-z]|\xc3[\x9f-\xbf]|[\xc4-\xc5][\x80-\xbf])"
_TITLES = rb"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Mlle|Monsieur|Madame|Se\xc3\xb1ora?|Sra?|Don|Do\xc3\xb1a)"
_NAME = re.compile(rb"(?<![A-Za-z.\x80-\xff])(?:" + _TITLES + rb"\.? )?" + _BIG + _SMALL + rb"++(?:-" + _BIG + _SMALL + rb"++)?(?: [A-Z]\.)? (?:(?:von|van|de|del|la|du) )?" + _BIG + _SMALL + rb"++(?![A-Za-z\x80-\xff])")
_TITLE = re.compile(_TITLES + rb"\.? ")
_CUE = re.compile(
    rb"e-?mail|mail|phone|tel|call|fax|mobile|contact|card|visa|address|ssn|social|iban|account|name|signed|author|\bip\b|host|server|born|dear"
    rb"|anruf|handy|adresse|konto|karte|geboren|courriel|appel|portable|compte|carte|correo|llam|m\xc3\xb3vil|direcci|cuenta|tarjeta|nombre|nacid", re.I)
_COUNTER = re.compile(rb"version|isbn|issn|order|invoice|item|page|chapter|section|figure|serial|model|total|usd|eur|rechnung|seite|kapitel|facture|commande|chapitre|factura|pedido|cap\xc3\xadtulo|[$#]\x20?$", re.I)
#: Given names of four languages; what the labelers start from.
NAMES = frozenset(
    "james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen christopher nancy daniel lisa matthew betty anthony margaret mark sandra paul ashley steven kimberly andrew emily peter anna alice bob emma oliver "
    "jean pierre marie jacques claire camille louis sophie nicolas julien antoine françois andré rené hélène chloé élodie isabelle philippe michel "
    "hans maria klaus ursula stefan sabine wolfgang jürgen günter heike monika dieter uwe petra birgit jörg käthe heinrich karl andreas "
    "carlos carmen josé jose juan ana luis laura miguel lucía lucia javier sofía diego pilar manuel isabel pablo elena andrés ramón".encode().split()
)
_TLDS = frozenset(b"com org net edu gov io de fr es uk eu info ch at be nl it mx ar".split())
#: Numbers that E.164 gives to no country begin so.
_NO_COUNTRY = (b"0", b"28", b"83", b"89")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(x: bytes) -> bytes:
    return bytes(c for c in x if 48 <= c <= 57)


def emails(text: bytes) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: from each @ backwards, so that long runs without one cost nothing."""
    out, end, at = [], 0, text.find(b"@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text, start - 1, start):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find(b"@", max(at + 1, end))
    return out


def base_spans(text: bytes) -> tuple[list[Span], list[Span]]:
    """The base findings and the matches that failed their check, in bytes."""
    good: list[Span] = [("email", a, b) for a, b in emails(text)] if b"@" in text else []
    bad: list[Span] = []
    for m in _IP.finditer(text):
        (good if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b".")) else bad).append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if len(m[0]) < 64 else b""
        (good if 12 <= len(d) <= 19 and luhn(d) else bad).append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        (good if 9 <= len(_digits(m[0])) <= 15 else bad).append(("phone", m.start(), m.end()))
    return good, bad


def may_hold(texts: list[bytes]) -> dict[str, np.ndarray]:
    """For each text whether a kind of pattern can match at all, from counts over whole slices."""
    w = Words(texts, hashed=False)
    raw, ends = w.buf, w.base[1:] - 1

    def many(mask: np.ndarray, least: int) -> np.ndarray:
        at = np.concatenate(([0], np.cumsum(mask, dtype=np.int32)))
        return at[ends] - at[w.base[:-1]] >= least

    digit = (raw >= 48) & (raw <= 57)
    before = np.concatenate(([False], digit[:-1])) if len(raw) else digit
    after = np.concatenate((digit[1:], [False])) if len(raw) else digit
    buf, masked = w.buf.tobytes(), np.zeros(len(texts), bool)
    for needle in (b"(at)", b"[at]", b"(AT)", b"[AT]"):
        find_rows(buf, w.base, needle, masked)
    # Two words in a row that begin with a capital, or with a byte beyond ASCII.
    first = raw[w.start] if len(w.start) else raw[:0]
    second = raw[np.minimum(w.start + 1, max(len(raw) - 1, 0))] if len(w.start) else raw[:0]
    capital = (((first >= 65) & (first <= 90)) | (first == 0xC3)) & ~((second >= 65) & (second <= 90))
    row = capital[:-1] & capital[1:] if len(capital) else capital
    named = np.zeros(len(texts), bool)
    named[np.searchsorted(w.base, w.start[:-1][row], "right") - 1] = True
    return {
        "email": many(raw == 64, 1), "ip": many((raw == 46) & before & after, 3), "card": many(digit, 12), "phone": many((raw == 43) & after, 1) & many(digit, 9),
        "masked_email": masked, "national_phone": many(digit, 10), "ssn": many((raw == 45) & before & after, 2), "iban": many(digit, 2) & many((raw >= 65) & (raw <= 90), 2), "name": named,
    }


def base_spans(text: bytes, only: frozenset[str] = frozenset(KINDS)) -> tuple[list[Span], list[Span]]:
    """The base findings and the matches that failed their check, in bytes; of the kinds that can match."""
    good: list[Span] = [("email", a, b) for a, b in emails(text)] if "email" in only else []
    bad: list[Span] = []
    for m in _IP.finditer(text) if "ip" in only else ():
        (good if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b".")) else bad).append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text) if "card" in only else ():
        d = _digits(m[0]) if len(m[0]) < 64 else b""
        (good if 12 <= len(d) <= 19 and luhn(d) else bad).append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "phone" in only else ():
        (good if 9 <= len(_digits(m[0])) <= 15 else bad).append(("phone", m.start(), m.end()))
    return good, bad


#: A candidate: its span, the votes (1 for, -1 against, 0 abstains), the classifier's features, and of a name the family name and whether something speaks for it.
Candidate = tuple[Span, tuple[int, ...], tuple[int, ...], bytes, bool]


def candidates(text: bytes, only: frozenset[str] = frozenset((*KINDS, *MORE_KINDS))) -> tuple[list[Span], list[Candidate]]:
    """The base spans, and every candidate span."""
    good, bad = base_spans(text, only)
    bad = [s for s in bad if s[0] != "card" or 12 <= len(_digits(text[s[1] : min(s[2], s[1] + 64)])) <= 19]
    extra: list[Span] = []
    for kind, pattern in (("masked_email", _MASKED), ("national_phone", _NATIONAL), ("ssn", _SSN), ("iban", _IBAN), ("name", _NAME)):
        if kind in only:
            extra += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    taken = sorted((a, b) for _, a, b in good)
    free = [s for s in extra if not any(a < s[2] and s[1] < b for a, b in taken)]
    out = []
    for spans, passed in ((good, True), (bad, False), (free, None)):
        for s in spans:
            v = votes(text, s, passed)
            family = text[s[1] : s[2]].split()[-1].decode(errors="replace").lower().encode() if s[0] == "name" else b""
            out.append((s, v, features(text, s), family, s[0] == "name" and (v[2] > 0 or bool(_TITLE.match(text, s[1])))))
    return good, out


def features(text: bytes, span: Span) -> tuple[int, ...]:
    """Numbers of the classifier's features: hashed words before (as such and by distance) and after, length and digits of the span."""
    kind, a, b = span
    before, after = re.findall(rb"[^\W_]+", text[max(0, a - 40) : a].lower())[-3:], re.findall(rb"[^\W_]+", text[b : b + 30].lower())[:2]
    words = [zlib.crc32(b"b" + w) % CONTEXT for w in before] + [zlib.crc32(b"n" + w) % CONTEXT for w in before[-1:]] + [zlib.crc32(b"a" + w) % CONTEXT for w in after]
    digits = len(_digits(text[a : min(b, a + 64)]))
    return tuple(sorted({*words, CONTEXT + min((b - a) // 4, 11), CONTEXT + 12 + min(digits // 2, 11)}))


def votes(text: bytes, span: Span, passed: bool | None) -> tuple[int, ...]:
    """One vote of each labeler but the last, which learns from the table."""
    kind, a, b = span
    body, before = text[a:b], text[max(0, a - 40) : a]
    d = _digits(body[:64])
    form = {True: 1, False: -1, None: 0}[passed]
    if kind in ("masked_email", "iban"):
        form = 1
    checksum = 0
    if kind == "card":
        checksum = 1 if luhn(d) else -1
    elif kind == "iban":
        compact = body.replace(b" ", b"").decode()
        checksum = 1 if int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1 else -1
    elif kind == "ssn":
        checksum = -1 if d[:3] in (b"000", b"666") or d[:1] == b"9" or d[3:5] == b"00" or d[5:] == b"0000" else 1
    elif kind == "ip":
        # Networks that stand for no host on the internet.
        top = [int(x[:4] or 0) for x in body.split(b".")]
        checksum = -1 if top[0] in (0, 127) or top[0] > 223 or max(top) > 255 or body[:1] == b"0" else 1
    elif kind == "phone":
        checksum = -1 if d.startswith(_NO_COUNTRY) else 1
    elif kind == "national_phone":
        checksum = -1 if d[:1] in b"01" or d[3:4] in b"01" else 1
    gazetteer = 0
    if kind == "name":
        gazetteer = 1 if any(w in NAMES for w in body.decode(errors="replace").lower().replace(".", "").encode().split()) else -1
    elif kind in ("email", "masked_email"):
        gazetteer = 1 if re.split(rb"[^a-z]+", body.lower().rstrip(b"])"))[-1] in _TLDS else -1
    cue = 1 if _CUE.search(before) or (kind == "name" and _TITLE.match(body)) else 0
    counter = -1 if _COUNTER.search(before) else 0
    shape = 0
    if d and kind not in ("email", "masked_email", "name", "iban"):
        shape = -1 if len(set(d)) <= 2 or d in b"01234567890123456789" else 0
    elif kind == "name":
        # A capital after the end of a sentence says little.
        shape = -1 if not before.strip() or before.rstrip()[-1:] in b".!?:" else 0
    return form, checksum, gazetteer, cue, counter, shape


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60, applies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns (rows of -1, 0, 1) and their counts.

    Returns the probability that each pattern is personal data, the vote
    probabilities [labeler, class, vote + 1] and the prior. It starts from the
    sum of the votes; a labeler's votes are smoothed by one count, right ones by
    two. ``applies`` tells which labelers look at a pattern's kind of span at
    all; of the others nothing is learned from it.
    """
    applies = np.ones(patterns.shape, bool) if applies is None else applies
    p = 1 / (1 + np.exp(-(patterns.sum(1) - 0.5)))
    theta, prior = np.full((patterns.shape[1], 2, 3), 1 / 3), 0.5
    for _ in range(rounds):
        weight = np.stack([counts * (1 - p), counts * p])
        prior = float(np.clip((weight[1].sum() + 1) / (counts.sum() + 2), 0.01, 0.99))
        log = np.zeros((2, len(patterns)))
        for k in range(patterns.shape[1]):
            for v in (-1, 0, 1):
                theta[k, :, v + 1] = (weight * ((patterns[:, k] == v) & applies[:, k])).sum(1) + 1
            theta[k, [0, 1], [0, 2]] += 1
            theta[k] /= theta[k].sum(1, keepdims=True)
            log += np.where(applies[:, k], np.log(theta[k][:, patterns[:, k] + 1]), 0)
        p = 1 / (1 + np.exp(np.clip(np.log(1 - prior) + log[0] - np.log(prior) - log[1], -50, 50)))
    return p, theta, prior


def design(kinds: list[str], votes: np.ndarray, features: list[list[int]]) -> np.ndarray:
    """The classifier's input: kind, votes, words around the span and its shape."""
    every = [*KINDS, *MORE_KINDS]
    rows = np.arange(len(kinds))
    hot = np.zeros((len(kinds), len(every)))
    hot[rows, [every.index(k) for k in kinds]] = 1
    seen = np.zeros((len(kinds), CONTEXT + SHAPES))
    if features:
        seen[np.repeat(rows, [len(f) for f in features]), np.concatenate([np.asarray(f, np.int64) for f in features])] = 1
    return np.concatenate([np.ones((len(kinds), 1)), hot, votes == 1, votes == -1, seen], 1).astype(float)


def classifier(x: np.ndarray, soft: np.ndarray, counts: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression on soft labels, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (counts * (soft - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: The kinds of span that each labeler looks at.
_LOOKS = {
    "form": {*KINDS, "masked_email", "iban"}, "checksum": {"ip", "card", "phone", "iban", "ssn", "national_phone"}, "gazetteer": {"email", "masked_email", "name"},
    "cue": {*KINDS, *MORE_KINDS}, "counter_cue": {*KINDS, *MORE_KINDS}, "shape": {"ip", "card", "phone", "ssn", "national_phone", "name"}, "learned": {"name"},
}


def soft_labels(patterns: list[tuple[str, str, int]]) -> dict[tuple[str, str], float]:
    """The probability that each kind and vote pattern, given with its count, is personal data."""
    if not patterns:
        return {}
    patterns = sorted(patterns)
    x = np.array([[int(v) for v in votes.split()] for _, votes, _ in patterns])
    applies = np.array([[kind in _LOOKS[k] for k in LABELERS] for kind, _, _ in patterns])
    p = estimate(x, np.array([n for *_, n in patterns], float), applies=applies)[0]
    return {(kind, votes): float(q) for (kind, votes, _), q in zip(patterns, p)}


_CANDIDATE = "struct<kind:string,start:long,end:long,votes:string,features:array<int>,family:string,told:boolean>"


def personal_spans(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7, max_fit: int = MAX_FIT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: one row for each row of ``docs``.

    Counts and digest are of the base findings; ``spans`` adds candidates of
    other kinds, or whose base check failed, to which the classifier gives
    ``least`` probability. Vote patterns, at most 9 * 3^7, and the features of
    ``max_fit`` candidates reach the driver. A null text is empty; null ids and
    repeated rows are kept; an empty table gives an empty result; other columns
    are ignored. A very long text is searched whole, in linear time, with about
    30 bytes of arrays a byte in its worker.
    """

    def work(batches):
        for batch in batches:
            for i, j, texts in text_slices(batch.column(1)):
                out, can = [], may_hold(texts)
                some = np.any(list(can.values()), axis=0).tolist()
                for k, t in enumerate(texts):
                    good, found = candidates(t, frozenset(x for x, ok in can.items() if ok[k])) if some[k] else ([], [])
                    spans = in_code_points(t, good + [c[0] for c in found])
                    more = [{"kind": s[0], "start": s[1], "end": s[2], "votes": " ".join(map(str, c[1])), "features": c[2], "family": c[3].decode(errors="replace"), "told": c[4]} for s, c in zip(spans[len(good) :], found)]
                    out.append((*(sum(s[0] == k for s in good) for k in KINDS), joined(spans[: len(good)], KINDS), more))
                span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.string()), ("features", pa.list_(pa.int32())), ("family", pa.string()), ("told", pa.bool_())])
                kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(span)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x, t) for x, t in zip(zip(*out), kinds))], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "found"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_binary(text_col).alias("text"))
    found = given.mapInArrow(work, f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, found array<{_CANDIDATE}>")
    found = stage_table(spark, found.withColumn("row", F.monotonically_increasing_id()), "candidates")

    # Family names: of all candidates that end in them, three at least and one of five have a title or a known given name.
    names = found.select("row", F.posexplode("found").alias("at", "c")).filter("c.kind = 'name'").select("row", "at", "c.family", "c.told")
    learned = names.groupBy("family").agg(F.sum(F.col("told").cast("int")).alias("told"), F.count("*").alias("n")).filter("told >= 3 and told * 5 >= n").select("family")
    marks = names.join(small(stage_table(spark, learned, "families")), "family", "left_semi").groupBy("row").agg(F.collect_set("at").alias("learned"))
    voted = found.join(small(stage_table(spark, marks, "marks")), "row", "left")
    known = F.coalesce(F.col("learned"), F.array().cast("array<int>"))
    full = F.transform("found", lambda c, i: c.withField("votes", F.concat(c["votes"], F.when(F.array_contains(known, i), " 1").when(c["kind"] == "name", " -1").otherwise(" 0"))))
    voted = voted.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", full.alias("found"))

    each = voted.select(F.explode("found").alias("c"))
    patterns = [(r["kind"], r["votes"], r["n"]) for r in each.groupBy("c.kind", "c.votes").agg(F.count("*").alias("n")).collect()]
    soft = soft_labels(patterns)
    rows = voted.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.kind", "c.start", "c.end", "c.votes", "c.features")
    fit = smallest(rows, F.xxhash64(*rows.columns), max_fit, sum(n for *_, n in patterns)).select("kind", "votes", "features").collect()
    weights = None
    if fit:
        x = design([r["kind"] for r in fit], np.array([[int(v) for v in r["votes"].split()] for r in fit]), [r["features"] for r in fit])
        weights = classifier(x, np.array([soft[r["kind"], r["votes"]] for r in fit]), np.ones(len(fit)))

    def finish(batches):
        for batch in batches:
            rows = batch.column(6).to_pylist()
            every = [c for row in rows for c in row]
            p = np.zeros(0)
            if every:
                x = design([c["kind"] for c in every], np.array([[int(v) for v in c["votes"].split()] for c in every]), [c["features"] for c in every])
                p = 1 / (1 + np.exp(-x @ weights))
            spans, added, digests, at = [], [], [], 0
            for base, row in zip(batch.column(5).to_pylist(), rows):
                own = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(",") if s)]
                more = [(c["kind"], c["start"], c["end"]) for c, q in zip(row, p[at : at + len(row)]) if q >= least]
                at += len(row)
                spans.append(joined(own + more, KINDS))
                added.append(len(set(more) - set(own)))
                digests.append(digest(base))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return voted.mapInArrow(finish, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
