"""Personal information inside free text: weak-supervision aggregation over candidate spans.

Broad patterns propose spans; a shape labeler (regular expressions), a gazetteer labeler (given names, family names, domains,
street words), a context labeler (words beside the span) and a decoy labeler (words that name numbers and bodies of things)
vote on each. The votes are counted by pattern over all spans; expectation-maximisation over these counts estimates how
reliable each labeler is for each kind. A logistic classifier of the span's votes, shape, neighbouring words and field is
trained on the posteriors of a bounded sample of spans, and decides for every span, so that two spans of one vote pattern may
end differently. The counts are at most kinds x votes, whatever the data; spans, gazetteers and decisions stay in Spark.

Defined results: null and empty fields hold nothing; a value that stands repeatedly in a field counts once; equal rows give
equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.llm.names import FIRM_WORDS, NICKNAMES, entry_name
from mailweave.llm.newtext import key
from mailweave.sources.tables import checkpointed, sized_join

KINDS = ["email", "phone", "id_number", "street", "name"]
VOTES = ["shape", "gazetteer", "context", "clear"]
# Words that names of firms, teams and units hold.
BODY_WORDS = [
    "company", "corporation", "incorporated", "limited", "partners", "international", "transmission", "marketing", "trading", "pipeline", "storage", "terminals", "services", "energy", "power", "gas", "team", "desk", "group", "department", "committee", "office",
    "north", "south", "east", "west", "control", "operations", "board", "union", "bank", "agency", "llc", "llp", "plc", "gmbh",
]
# What numbers of things stand behind.
THING_WORDS = ["meter", "invoice", "contract", "deal", "deal no", "order", "ticket", "item", "po", "account", "ref", "case", "lot", "page", "line", "tab", "permit", "policy", "tracking"]
# What numbers issued to persons stand behind.
PERSON_NUMBER_WORDS = ["ssn", "social security", "passport", "licen[cs]e", "ni number", "national insurance", "badge form"]

# A gap inside a value: a blank, or a line break with the quote marks of the next line.
_G = r"(?:[ ]|[ ]?\n[>| \t]*)"
_EXT = rf"(?:,?{_G}?(?:x|ext\.?|extension){_G}?\d{{1,6}})?"
_PHONE = (
    rf"\+1(?:{_G}|[.-])\(?\d{{3}}\)?(?:{_G}|[.-])\d{{3}}(?:{_G}|[.-])\d{{4}}{_EXT}|\+44{_G}\d{{2,4}}{_G}\d{{3,4}}{_G}\d{{3,4}}{_EXT}|\+49{_G}\d{{2,5}}{_G}\d{{4,6}}{_G}\d{{2,4}}{_EXT}|\+\d{{2,3}}(?:[ .-]\d{{2,5}}){{2,4}}{_EXT}"
    rf"|(?:1[ .-])?\(\d{{3}}\){_G}?\d{{3}}[ .-]\d{{4}}{_EXT}|(?:1[.-])?\d{{3}}([.-])\d{{3}}\1\d{{4}}{_EXT}|(?<![\d.-])\d{{10}}(?![\d.-])"
)
_ID = rf"\d{{3}}-\d{{2}}-\d{{4}}|\d{{3}}{_G}\d{{2}}{_G}\d{{4}}|[A-Z]-\d{{3}}-\d{{4}}-\d{{2}}|\d{{3}}-\d{{4}}-\d{{2}}|[A-Z]{{2}}{_G}?\d{{2}}{_G}\d{{2}}{_G}\d{{2}}{_G}?[A-Z]|[A-Z]{{1,2}}\d{{6,8}}|\d{{9}}"
_WORD = r"[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:['’-][A-Z]?[^\W\d_]+)*"
_STREET_WORDS = "Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Way|Place|Pl|Terrace|Square|Sq|Close|Crescent|Parkway|Pkwy|Highway|Hwy|Row|Gardens"
_UNIT = rf"(?:,?{_G}(?:Apt\.?|Apartment|Suite|Ste\.?|Unit|Flat|#)(?:{_G}?#?\d+[A-Z]?))?"
_STREET = (
    rf"\d{{1,5}}{_G}(?:(?:N|S|E|W|North|South|East|West)\.?{_G})?{_WORD}(?:{_G}{_WORD})?{_G}(?:{_STREET_WORDS})\b\.?{_UNIT}"
    rf"|\d{{1,5}},?{_G}(?:rue|avenue|place|boulevard)(?:{_G}(?:du|de|des|la|le))*{_G}{_WORD}{_UNIT}"
)
# Street names that come before their number.
_WAY = rf"(?<!\w){_WORD}(?:weg|stra(?:ß|ss|ÃŸ)e|strasse|str\.|platz|gasse|allee)"
_EMAIL = (
    rf"[\w.%+'-]+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?|[\w.%+'-]+{_G}?[\[({{]{_G}?(?:at|AT|@){_G}?[\])}}]{_G}?[\w-]+(?:{_G}?[\[({{]{_G}?(?:dot|DOT|\.){_G}?[\])}}]{_G}?[\w-]+)+"
    rf"|[\w.%+-]+{_G}(?:at|AT){_G}[\w-]+(?:{_G}(?:dot|DOT){_G}[\w-]+)+"
)
_PART = r"[A-ZÀ-ÖØ-ÞŠŽ][^\s,.;:<>()\[\]\"@/\\|!?0-9_*=#&+]*"
_INITIAL = r"[A-Z]\.(?:[A-Z]\.)*"
_RUN = rf"(?:{_INITIAL}|{_PART})(?:{_G}(?:{_INITIAL}|{_PART}))+"
_TURNED = rf"({_PART}),{_G}({_PART}|{_INITIAL})(?:{_G}[A-Z]\b\.?)?"


#: Bits of the filter of given names: 2 MB, whatever their number.
FILTER_BITS = 24
#: Buckets of the classifier's hashed features.
BUCKETS = 1 << 13


def _name_filter(given: DataFrame) -> bytes:
    """A Bloom filter of the tokens, two bits each, put together in Spark; its size is fixed by FILTER_BITS."""
    h, mask = F.xxhash64("token"), F.lit((1 << FILTER_BITS) - 1)
    places = given.select(F.explode(F.array(h.bitwiseAND(mask), F.shiftrightunsigned(h, FILTER_BITS).bitwiseAND(mask))).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")).toPandas()
    whole = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    whole[words["w"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return whole.tobytes()


def _spans(given):
    """Task: candidate spans (row_idx, kind, start, stop, run, value, left, right, first, m1, m2, last, turned) of the bodies.

    Numbers are looked at from their digits on, names from their capitals. A name begins with an initial or a given name and
    goes on over given names (m1, m2) and initials to its last part. ``given`` is a filter of the given names that lets all of
    them pass and few others; those others are told by a join afterwards.
    """
    phone, ident, street = re.compile(_PHONE), re.compile(_ID), re.compile(_STREET)
    digits, capitals, letters = re.compile(r"\d+"), re.compile("[A-ZÀ-ÖØ-ÞŠŽ]"), re.compile("[^a-z]")
    written, spelled = re.compile(rf"(?<![\w.%+'-])(?:{_EMAIL.split('|')[0]})"), re.compile(rf"(?<![\w.%+'-])(?:{_EMAIL.split('|', 1)[1]})")
    ways = re.compile(rf"{_WAY}{_G}$")
    runs, turned, parts = re.compile(_RUN), re.compile(_TURNED), re.compile(rf"{_INITIAL}|{_PART}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, mask, seen = given.value, (1 << FILTER_BITS) - 1, {}

        def known(word):
            if (hit := seen.get(word)) is None:
                if len(seen) > 500_000:
                    seen.clear()
                h = xxhash.xxh64_intdigest(word, seed=42)  # as Spark's xxhash64
                hit = seen[word] = all(bits[p >> 3] >> (p & 7) & 1 for p in (h & mask, h >> FILTER_BITS & mask))
            return hit

        for batch in batches:
            out = []
            for row, body in zip(batch["row_idx"], batch["body"]):
                if not body:
                    continue

                def add(kind, start, stop, run_no=0, first="", last="", is_turned=False, m1="", m2=""):
                    out.append((row, kind, start, stop, run_no, body[start:stop], body[max(0, start - 28) : start], body[stop : stop + 20], first, m1, m2, last, is_turned))  # noqa: B023

                if "@" in body:
                    for m in written.finditer(body):
                        add("email", m.start(), m.end())
                if "dot" in body or "DOT" in body:
                    for m in spelled.finditer(body):
                        add("email", m.start(), m.end())
                done = 0
                for d in digits.finditer(body):
                    at = d.start()
                    if at < done:
                        continue
                    before = body[at - 1] if at else " "
                    own = not (before.isalnum() or before in "._-+(")
                    m = None
                    if own or (before in "+(" and not (at > 1 and (body[at - 2].isalnum() or body[at - 2] in ".+("))):
                        m = phone.match(body, at if own else at - 1)
                        if m and not (m.end() < len(body) and (body[m.end()].isalnum() or body[m.end()] == "_")):
                            add("phone", m.start(), m.end())
                            done = m.end()
                            continue
                    begin = at
                    while begin and at - begin < 4 and (body[begin - 1].isupper() or (body[begin - 1] in "- " and begin > 1 and body[begin - 2].isupper())):
                        begin -= 1
                    for start in dict.fromkeys((begin, at)):
                        if start and (body[start - 1].isalnum() or body[start - 1] in "-_"):
                            continue
                        m = ident.match(body, start)
                        if m and not (m.end() < len(body) and (body[m.end()].isalnum() or body[m.end()] in "-_")):
                            add("id_number", m.start(), m.end())
                            done = m.end()
                            break
                    if done > at or not own:
                        continue
                    m = street.match(body, at)
                    if m:
                        add("street", m.start(), m.end())
                        done = m.end()
                    elif before in " \n|>" and (w := ways.search(body, max(0, at - 48), at)):
                        unit = re.match(rf"\d{{1,5}}[a-z]?(?!\w){_UNIT}", body[at : at + 40])
                        if unit:
                            add("street", w.start(), at + unit.end())
                            done = at + unit.end()
                done, number = 0, 0
                for c in capitals.finditer(body):
                    at = c.start()
                    if at and body[at - 1].isalnum():
                        continue
                    m = turned.match(body, at)
                    if m:
                        number += 1
                        second = letters.sub("", m[2].lower()) if len(m[2]) > 2 else ""
                        if not second or known(second):
                            add("name", m.start(), m.end(), -number, second, letters.sub("", m[1].lower()), True)
                    if at < done or not (m := runs.match(body, at)):
                        continue
                    done, number = m.end(), number + 1
                    found = [(p.start(), p.end()) for p in parts.finditer(body, m.start(), m.end())]
                    single = [body[e - 1] == "." or e - s == 1 for s, e in found]
                    plain = ["" if x else letters.sub("", body[a:b].lower()) for x, (a, b) in zip(single, found)]
                    for i in range(len(found) - 1):
                        if plain[i] and not known(plain[i]):
                            continue
                        if found[i][1] - found[i][0] == 1 and not body[found[i][0]].isascii():
                            continue  # a marked letter alone is a word, no initial
                        middle = []
                        for j in range(i + 1, len(found)):
                            if single[j]:
                                if j - i > 3 + len(middle):
                                    break
                                continue
                            add("name", found[i][0], found[j][1], number, plain[i], plain[j], False, *middle)
                            if len(middle) == 2 or not plain[j] or not known(plain[j]):
                                break
                            middle.append(plain[j])
            yield pd.DataFrame(out, columns=["row_idx", "kind", "start", "stop", "run", "value", "left", "right", "first", "m1", "m2", "last", "turned"])

    return run


def _any(words: list[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z]", "")


def gazetteers(mail: DataFrame, contacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(token, given) of given names and (token, family) of family names: the directory's, common short forms, and the display names of the mail."""
    people = contacts.filter("contact_kind = 'person'").select(F.split(F.trim("full_name"), r"\s+").alias("p")).filter(F.size("p") > 1)
    short = mail.sparkSession.createDataFrame(pd.DataFrame({"token": sorted({x for k, v in NICKNAMES.items() for x in [k, *v]})}))
    given = people.select(_letters(F.get("p", F.lit(0))).alias("token")).unionByName(short).filter("length(token) > 1").distinct().withColumn("given", F.lit(True))
    shown = mail.select(F.explode(F.concat(F.array("sender"), F.coalesce("recipients", F.array().cast("array<string>")), F.coalesce("cc", F.array().cast("array<string>")))).alias("e")).select(entry_name(F.col("e")).alias("n")).filter(f"not lower(n) rlike '{_any(BODY_WORDS)}'").distinct()
    last = F.when(F.col("n").contains(","), F.regexp_extract("n", r"^\s*([^,\s]+)\s*,", 1)).otherwise(F.regexp_extract(F.regexp_replace("n", r"^(?i:cn=)|[/@].*$", ""), r"(\S+)\s*$", 1))
    family = people.select(_letters(F.element_at("p", -1)).alias("token")).unionByName(shown.select(_letters(last).alias("token"))).filter("length(token) > 2").distinct().join(given.select("token"), "token", "left_anti").withColumn("family", F.lit(True))
    return given, family


def _voted(mail: DataFrame, contacts: DataFrame) -> DataFrame:
    """Candidate spans of all fields with their four votes and the classifier's features."""
    given, family = gazetteers(mail, contacts)
    given = checkpointed(given)
    names = mail.sparkSession.sparkContext.broadcast(_name_filter(given))
    body = mail.select("row_idx", "body").filter("length(body) > 0").mapInPandas(_spans(names), "row_idx long, kind string, start int, stop int, run int, value string, left string, right string, first string, m1 string, m2 string, last string, turned boolean").withColumns({"field": F.lit("body"), "item": F.lit(0)})
    entries = mail.select("row_idx", F.explode(F.concat(F.array(F.struct(F.lit("sender").alias("field"), F.lit(0).alias("item"), F.col("sender").alias("e"))), F.transform(F.coalesce("recipients", F.array().cast("array<string>")), lambda e, i: F.struct(F.lit("recipients").alias("field"), i.alias("item"), e.alias("e"))))).alias("x")).select("row_idx", "x.field", "x.item", F.coalesce("x.e", F.lit("")).alias("e"))
    address = entries.select("row_idx", "field", "item", "e", F.lit("email").alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all("e", F.lit(r"[^\s<>()\"]+@[^\s<>()\"]+\.[^\s<>()\"]+"), F.lit(0)))).alias("value"))
    person = F.regexp_replace(F.regexp_replace(entry_name(F.col("e")), r"^(?i:cn=)", ""), r"[/@].*$", "")
    words = F.regexp_extract_all(person, F.lit(r"\p{L}[^\s,.]*"), F.lit(0))
    named = entries.select("row_idx", "field", "item", "e", F.lit("name").alias("kind"), person.alias("value"), words.alias("w")).filter(F.size("w") >= 2)
    # a family name is written last, or first before a comma or an initial
    front = F.col("value").contains(",") | (F.length(F.element_at("w", -1)) == 1)
    first, last = _letters(F.when(front, F.element_at("w", 2)).otherwise(F.element_at("w", 1))), _letters(F.when(front, F.element_at("w", 1)).otherwise(F.element_at("w", -1)))
    empty = F.lit("")
    # where the value stands in the entry: once, as a rule
    places = F.expr("case when instr(e, value) = 0 then array() when locate(value, e, instr(e, value) + 1) = 0 then array(instr(e, value) - 1) else filter(sequence(0, length(e) - 1), i -> substring(e, i + 1, length(value)) = value) end")
    whole = lambda df, a, b: df.withColumn("start", F.explode(places)).select("row_idx", "kind", "start", (F.col("start") + F.length("value")).alias("stop"), F.lit(0).alias("run"), "value", empty.alias("left"), empty.alias("right"), a.alias("first"), empty.alias("m1"), empty.alias("m2"), b.alias("last"), F.lit(False).alias("turned"), "field", "item")
    spans = body.unionByName(whole(address, empty, empty)).unionByName(whole(named, first, last))

    spans = sized_join(spans, given.withColumnRenamed("token", "first"), "first", "left")
    # what the filter let pass and is no given name
    spans = spans.filter((F.col("kind") != "name") | (F.col("field") != "body") | (F.col("first") == "") | F.col("given"))
    for middle in ("m1", "m2"):
        spans = sized_join(spans, given.select(F.col("token").alias(middle), F.col("given").alias(f"{middle}_given")), middle, "left").filter(f"{middle} = '' or {middle}_given").drop(f"{middle}_given")
    spans = sized_join(spans, family.withColumnRenamed("token", "last"), "last", "left")
    left, right, value, field = F.lower("left"), F.lower("right"), F.lower("value"), F.col("field")
    flat = F.regexp_replace(left, r"[\s>|]+", " ")  # cues may be broken over lines
    thing = flat.rlike(rf"\b{_any(THING_WORDS)}(?:\s+no)?\.?\s*[#:]?\s*$")
    own = flat.rlike(rf"{_any(PERSON_NUMBER_WORDS)}(?:[^.;]|no\.){{0,24}}$")
    firm = value.rlike(rf"\b{_any(BODY_WORDS + sorted(FIRM_WORDS))}\b") | right.rlike(rf"^[\s>|]+{_any(BODY_WORDS)}\b")
    is_given, is_family, initial = F.coalesce("given", F.lit(False)), F.coalesce("family", F.lit(False)), F.coalesce(F.length("first") <= 1, F.lit(False))
    turned, broken, long = F.col("turned"), F.col("value").contains("\n"), F.col("m1") != ""
    name_before = flat.rlike(r"(?:\bto:|\bfrom:|\bcc:|\bfrom|\bby|\bwith|\bcopy|\bschrieb|\bwrote|\b\d{4},|\bdr\.|\bmr\.|\bms\.|\bmrs\.|\bprof\.|\basked|\btell) $|^$") | left.rlike(r"\n[>| \t]*$")
    name_after = right.rlike(r"^[\s>|]*(?:wrote|called|will|said|asked|who|on the|about|<|\[mailto|\n|-----|on \d|:)") | (F.col("right") == "")
    address_like = value.rlike(r"@[a-z0-9.-]+\.[a-z]{2,}$|(?:at|@)\W*[a-z0-9-]+\W+(?:dot|\.)\W*[a-z]{2,}")
    votes = {
        "email": (address_like, address_like, left.rlike(r"(?:<|mailto:|\[|to|from|at|with|\(|\n)[\s>|]*$") | (field != "body") | right.rlike(r"^\s*(?:>|\]|\)|today|twice|\n|$)"), ~value.rlike(r"^\W*\d+\W*@")),
        "phone": (F.length(F.regexp_replace("value", r"(?i)(?:x|ext).*$|\D", "")).between(9, 15) & ~value.rlike(r"^\d{10}$"), value.rlike(r"^\+|^\(|^1[-.]|\d{3}[-.]\d{3}[-.]\d{4}"), left.rlike(r"(?:phone|tel|fax|mobile|cell|call|line is|me on|\bt|\bm|to|at|\n)[.:]?[\s>|]*$"), ~thing),
        "id_number": (value.rlike(r"^\d{3}[-\s].|^[a-z]-|^[a-z]{1,2}\s*\d|^\d{9}$"), own & ~value.rlike(r"^\d{3}-\d{4}-"), own, ~thing),
        "street": (F.lit(True), F.col("value").rlike(rf"(?i)\b(?:{_STREET_WORDS}|rue|avenue|boulevard|place)\b|weg\b|stra|str\.|platz|gasse|allee"), left.rlike(r"(?:\n[>| \t]*|\bto|\bat|\bof)\s*$") | right.rlike(r"^\.?\s*\n"), ~thing),
        "name": ((is_given | initial | (field != "body")) & ~firm & (~turned | (is_family & (field == "body")) | (field != "body")) & (~long | is_family), (is_given & (is_family | ~(broken | long))) | (initial & is_family) | (is_family & (field != "body")), F.when(field != "body", True).otherwise(name_before | name_after), ~firm & ~left.rlike(r"\d[\s>|]+$") & ~value.rlike(rf"\s(?:{_STREET_WORDS.lower()})$")),
    }
    for n, vote in enumerate(VOTES):
        chosen = F.coalesce(*[F.when(F.col("kind") == k, votes[k][n]) for k in KINDS])
        spans = spans.withColumn(vote, F.coalesce(chosen, F.lit(False)))
    pattern = sum((F.col(v).cast("int") * (1 << n) for n, v in enumerate(VOTES)), F.lit(0))
    small, capitals, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    shape = F.translate("value", capitals + digits + small, "A" * len(capitals) + "9" * len(digits))  # small letters fall out
    before, after = F.substring_index(F.rtrim(flat), " ", -1), F.substring_index(F.ltrim(F.translate(right, "\n>|", "   ")), " ", 1)
    told = [F.lit(0), pattern, shape, before, after, field]
    features = F.array(*[F.pmod(F.xxhash64("kind", F.lit(n), f), F.lit(BUCKETS)).cast("int") for n, f in enumerate(told)])
    return spans.select("row_idx", "field", "item", "kind", "start", "stop", "run", key(F.col("value")).alias("value_key"), *VOTES, features.alias("features"))


def reliabilities(counts: pd.DataFrame, rounds: int = 50, belief: float = 0.9, weight: float = 0.25) -> pd.DataFrame:
    """Posterior of each vote pattern of each kind, by expectation-maximisation over (kind, votes, n).

    Reliabilities are held near ``belief`` by a prior worth ``weight`` of a kind's spans, so that a kind without wrong spans
    isn't split in two.
    """
    found = []
    for kind, own in counts.groupby("kind"):
        v, n = own[VOTES].to_numpy(float), own["n"].to_numpy(float)
        total = n.sum()
        hit, miss, share = np.full(len(VOTES), belief), np.full(len(VOTES), 1 - belief), 0.5
        for _ in range(rounds):
            yes = np.log(share) + (v * np.log(hit) + (1 - v) * np.log(1 - hit)).sum(1)
            no = np.log(1 - share) + (v * np.log(miss) + (1 - v) * np.log(1 - miss)).sum(1)
            p = 1 / (1 + np.exp(np.clip(no - yes, -50, 50)))
            a, b = (n * p), (n * (1 - p))
            hit = (a @ v + belief * weight * total) / (a.sum() + weight * total)
            miss = (b @ v + (1 - belief) * weight * total) / (b.sum() + weight * total)
            share = float(np.clip((a.sum() + 1) / (total + 2), 0.01, 0.99))
        found.append(own.assign(posterior=p))
    return pd.concat(found) if found else counts.assign(posterior=0.0)


def classifier(features: np.ndarray, belief: np.ndarray, share: np.ndarray, rounds: int = 300, rate: float = 0.5, pull: float = 1e-5) -> np.ndarray:
    """Weights by bucket of a logistic model of the spans' features (n x k buckets), trained on their posteriors ``belief``."""
    w, seen = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(w[features].sum(1), -30, 30)))
        slope = np.bincount(features.ravel(), np.repeat(share * (p - belief), features.shape[1]), BUCKETS) + pull * w
        seen += slope**2
        w -= rate * slope / np.sqrt(seen)
    return w


def _trained(spans: DataFrame, sample: int) -> np.ndarray:
    """Weights of the span classifier: posteriors from the votes of all spans, trained on about ``sample`` spans of each kind and vote pattern, chosen by hash."""
    by = ["kind", *VOTES]
    counts = spans.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most kinds x 2 ** votes
    if counts.empty:
        return np.zeros(BUCKETS)
    judged, parts = reliabilities(counts), 1 << 20
    judged["keep"] = np.minimum(parts, np.ceil(parts * sample / judged["n"])).astype(int)
    rates = F.broadcast(spans.sparkSession.createDataFrame(judged[[*by, "keep"]]))  # a row for each pattern
    chosen = spans.join(rates, by).filter(F.pmod(F.xxhash64("row_idx", "field", "item", "start", "stop"), F.lit(parts)) < F.col("keep"))
    local = chosen.select(*by, "features").limit(2 * sample * len(judged)).toPandas().merge(judged, on=by)
    # a pattern weighs as its part of its kind; rare ones count a little
    part = judged["n"] / judged.groupby("kind")["n"].transform("sum") + 0.02
    share = local[by].merge(judged[by].assign(part=part), on=by)["part"].to_numpy() / local.groupby(by)["n"].transform("size").to_numpy(float)
    return classifier(np.stack(local["features"].to_numpy()), local["posterior"].to_numpy(), share)


def personal_spans(mail: DataFrame, contacts: DataFrame, sample: int = 4_000) -> DataFrame:
    """(row_idx, field, item, kind, start, stop, value_key): the accepted spans; start and stop are code points of the body or of the entry, item is the entry's place in its field, from 0.

    ``sample`` is about the number of spans of each kind and vote pattern that the classifier is trained on.
    """
    spans = checkpointed(_voted(mail, contacts))
    weights = F.from_json(F.lit(json.dumps([round(x, 6) for x in _trained(spans, sample)])), "array<double>")
    accepted = spans.filter(F.aggregate("features", F.lit(0.0), lambda s, i: s + F.get(weights, i)) > 0)
    alone = accepted.filter("kind <> 'name' or field <> 'body'")
    # of the candidates of one run of words, those inside no other
    names = accepted.filter("kind = 'name' and field = 'body'")
    together = names.groupBy("row_idx", "run").agg(F.collect_list(F.struct("start", "stop", "value_key")).alias("s"))
    outer = F.filter("s", lambda a: ~F.exists("s", lambda b: (b["start"] <= a["start"]) & (b["stop"] >= a["stop"]) & ((b["stop"] - b["start"]) > (a["stop"] - a["start"]))))
    kept = together.select("row_idx", F.explode(outer).alias("s")).select("row_idx", F.lit("body").alias("field"), F.lit(0).alias("item"), F.lit("name").alias("kind"), "s.start", "s.stop", "s.value_key")
    return alone.select("row_idx", "field", "item", "kind", "start", "stop", "value_key").unionByName(kept).filter("value_key <> ''")


def found(mail: DataFrame, contacts: DataFrame) -> DataFrame:
    """(row_idx, field, kind, value_key): each personal value standing in body, sender or recipients."""
    return personal_spans(mail, contacts).select("row_idx", "field", "kind", "value_key").distinct()


def redacted(mail: DataFrame, contacts: DataFrame) -> DataFrame:
    """(row_idx, body, sender, recipients): each with its personal values replaced by placeholders of their kinds, such as [PHONE]."""
    one = F.struct("item", "start", "stop", F.upper("kind").alias("kind"))
    spans = personal_spans(mail, contacts).groupBy("row_idx").agg(*[F.array_sort(F.collect_set(F.when(F.col("field") == f, one))).alias(f"_{f}") for f in ("body", "sender", "recipients")])  # of one mail
    begin = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def filled(text: Column, own: Column) -> Column:
        step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(F.concat(acc["done"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("done"), s["stop"].alias("at")))
        rest = lambda acc: F.concat(acc["done"], F.substring(text, acc["at"] + 1, F.length(text)))
        return F.when(F.coalesce(F.size(own), F.lit(0)) < 1, text).otherwise(F.aggregate(own, begin, step, rest))

    joined = mail.select("row_idx", "body", "sender", "recipients").join(spans, "row_idx", "left")
    entries = F.transform("recipients", lambda e, i: filled(e, F.filter("_recipients", lambda s: s["item"] == i)))
    return joined.select("row_idx", filled(F.col("body"), F.col("_body")).alias("body"), filled(F.col("sender"), F.col("_sender")).alias("sender"), entries.alias("recipients"))
