import hashlib
import itertools
import random
import re

import pytest
import xxhash

from mailweave.llm import components, encoding, leakage, mixture, names, neardup, newtext, pii, queries, spans

MAIL = "row_idx long, message_id string, subject string, date_text string, sender string, recipients array<string>, cc array<string>, body string, in_reply_to string, ref_ids array<string>, source_file string, loaded_at timestamp_ntz, mailbox string, source string"
SMALL = "/root/testdata/sf0.001"
WORDS = re.compile("[a-z0-9]+")
WHO = ["Anna", "Bertram", "Cosima", "Dorian", "Edwina", "Fabian", "Gerda", "Hanno", "Irina", "Jasper"]


def mail(spark, rows):
    base = dict.fromkeys([c.split()[0] for c in MAIL.split(", ")])
    return spark.createDataFrame([tuple((base | {"row_idx": i} | r).values()) for i, r in enumerate(rows, 1)], MAIL)


def contacts(spark, rows=(("Robert Siladale", "person"), ("Oskar Kelisemire", "person"), ("Moninova Energy Services Incorporated", "organisation"))):
    return spark.createDataFrame([(i, n, k, n.split()[0].lower() + "@firm.example") for i, (n, k) in enumerate(rows, 1)], "contact_id long, full_name string, contact_kind string, email string")


def ingest(spark, pairs):
    return spark.createDataFrame(pairs, "row_idx long, thread_id string")


def boxes(spark):
    return spark.createDataFrame([("a", "UTC", False)], "mailbox string, home_zone string, day_first boolean")


def key(text):
    return hashlib.md5(re.sub("[^a-z0-9]", "", text.lower()).encode()).hexdigest()


def test_personal_values(spark):
    body = "Call me on +49 30\n> 23125 748 or (313)555-0122 ext. 47.\nFor the audit, his SSN is 956-16-7045. Meter 934-42-1777 missed it. Invoice 7135393168 too.\nWe moved to 90 N. Tallow St., Apt. 5 in March. Send it to a.b [at] firm [dot] example. Dr. BOB SILADALE will chair. The Gas Control North Team agreed.\nHi Oskar,\nÀ DISPOSIÇÃO"
    df = mail(spark, [{"body": body, "sender": "Siladale, Robert X <robert@firm.example>", "recipients": ["Moninova Energy Inc", None]}, {}, {"body": ""}])
    got = {(r.field, r.kind, r.value_key) for r in pii.found(df, contacts(spark)).collect()}
    assert got >= {("body", "phone", "493023125748"), ("body", "phone", "3135550122ext47"), ("body", "id_number", "956167045"), ("body", "street", "90ntallowstapt5"), ("body", "email", "abatfirmdotexample"), ("body", "name", "bobsiladale"), ("sender", "name", "siladalerobertx"), ("sender", "email", "robertfirmexample")}
    assert not {v for _, _, v in got} & {"934421777", "7135393168", "moninovaenergyinc", "oskar", "disposio"}
    text = {r.row_idx: r.body for r in pii.redacted(df, contacts(spark)).collect()}
    assert "[PHONE]" in text[1] and "956-16-7045" not in text[1] and "will chair" in text[1] and text[2] is None and text[3] == ""


def test_redacted_entries(spark):
    rows = [
        {"sender": "Siladale, Robert X <robert@firm.example>", "recipients": ["Moninova Energy Inc", None, '"Oskar Kelisemire" <oskar@firm.example>', "CN=Oskar Kelisemire/OU=HOU/O=X"], "body": "Call me on (313)555-0122."},
        {"sender": "oskar@firm.example (Oskar Kelisemire)", "recipients": [], "body": None},
        {"sender": "'robert@firm.example' <robert@firm.example>", "recipients": None},
    ]
    got = {r.row_idx: (r.body, r.sender, r.recipients) for r in pii.redacted(mail(spark, rows), contacts(spark)).collect()}
    assert got == {
        1: ("Call me on [PHONE].", "[NAME] <[EMAIL]>", ["Moninova Energy Inc", None, '"[NAME]" <[EMAIL]>', "CN=[NAME]/OU=HOU/O=X"]),
        2: (None, "[EMAIL] ([NAME])", []),
        3: (None, "'[EMAIL]' <[EMAIL]>", None),
    }


def brute_pairs(texts, width=3, least=20, j=0.6):
    sets = {}
    for i, t in texts.items():
        w = WORDS.findall((t or "").lower())
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if min(len(sets[a]), len(sets[b])) >= least and len(sets[a] & sets[b]) >= j * len(sets[a] | sets[b])}


def test_near_duplicates(spark):
    rng = random.Random(1)
    texts = {}
    for g in range(12):
        words = [f"w{rng.randrange(4000)}" for _ in range(120)]
        for v in range(6):
            own = list(words)
            for _ in range(v * 4):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9999)}"
            texts[g * 10 + v] = " ".join(own)
        texts[g * 10 + 7] = " ".join(words)
    texts |= {900: None, 901: "", 902: "few words", 903: "few words", 904: "a b " * 60}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    assert {tuple(r) for r in neardup.similar_pairs(df).collect()} == brute_pairs(texts)
    assert neardup.similar_pairs(spark.createDataFrame([], "id long, text string")).collect() == []


def test_texts_too_short_to_be_alike(spark):
    rows = [{"subject": "Prices", "body": "a few more words than three stand here"}] * 3 + [{"body": None}, {"body": ""}]
    assert neardup.similar_mail(mail(spark, rows)).collect() == []
    assert neardup.grouped_mail(mail(spark, rows)).collect() == []


def test_masks_cover():
    for a, b in itertools.combinations(range(7), 2):
        assert any(all(not (mask >> (9 * f)) & 511 for f in (a, b)) for mask in neardup.MASKS)


@pytest.mark.parametrize("share", [0, 1])
def test_reply_groups(spark, share):
    rows = [{"message_id": "<A@x>"}, {"message_id": "<b@x>", "in_reply_to": "a@X of 3 May"}, {"message_id": None, "ref_ids": ["<B@x> <zz@x>", None]}, {"message_id": "<c@x>"}, {"message_id": "<c@x>"}, {"message_id": "<d@x>", "in_reply_to": "<gone@x>"}, {}]
    rows += [{"message_id": f"<n{i}@x>", "in_reply_to": f"<n{i - 1}@x>"} for i in range(1, 40)]
    got = {tuple(r) for r in components.reply_groups(mail(spark, rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)} | {(i, 8) for i in range(8, 47)}
    edges = spark.createDataFrame([(0, i) for i in range(1, 30)] + [(i, i + 30) for i in range(1, 30)] + [(100, 101)], "u long, v long")
    assert {tuple(r) for r in components.components(edges, patience=share).collect()} == {(i, 0) for i in [*range(31), *range(31, 60)] if i != 30} | {(100, 100), (101, 100)}


def test_encoding(spark):
    clean = ["le café est très près du bar, à côté", "größer als früher, ein übles Büro", "it’s late – €40 now"]
    rows = [{"body": t, "source_file": "maildir/a/inbox/1."} for t in clean * 12]
    wrong = {}
    for page in ("cp1252", "mac_roman", "cp850", "cp437", "cp1251"):
        for t in clean:
            try:
                rows.append({"body": t.encode().decode(page) + " end", "source_file": "maildir/b/inbox/1."})
                wrong[len(rows)] = t + " end"
            except UnicodeDecodeError:
                pass
    tree = "Folder tree: └── end"  # another page reads private characters out of it
    rows.append({"body": tree.encode().decode("cp850"), "source_file": "maildir/b/inbox/1."})
    wrong[len(rows)] = tree
    rows += [{"body": "lost caf�"}, {"body": None}, {"body": "plain"}]
    got = {r.row_idx: r.restored_md5 for r in encoding.found(mail(spark, rows)).collect()}
    assert got == {i: hashlib.md5(t.encode()).hexdigest() for i, t in wrong.items()} | {len(rows) - 2: ""}


def test_names(spark):
    rows = [{"sender": "Bob Siladale <ops@x.example>", "cc": ["Siladale, R.", "Robert Siladale", "OSKAR KELISEMIRE", None]}, {"sender": "Kelsiemire Oskar"}, {"sender": "CN=Oskar Kelisemire/OU=HOU/O=X"}, {"sender": "The Moninova Energy Inc"}, {"sender": "Anna Siladale"}, {"sender": "x@y.example (rsiladale)"}, {"sender": "bob@x.example"}, {}]
    got = {tuple(r) for r in names.linked_entries(mail(spark, rows), contacts(spark)).collect()}
    assert got == {(1, "sender", 1), (1, "cc", 1), (1, "cc", 2), (2, "sender", 2), (3, "sender", 2), (4, "sender", 3), (6, "sender", 1)}


def test_new_text(spark):
    first = "The first paragraph that was written here long ago."
    rows = [
        {"message_id": "<1@x>", "body": f"Hi,\n\n{first}", "date_text": "2001-01-01 00:00:00Z"},
        {"message_id": "<2@x>", "body": f"New words of mine.\n\n{first.replace('was ', 'was' + chr(10))}\n\nCheers,\nBob", "date_text": "2001-01-02 00:00:00Z"},
        {"message_id": "<3@x>", "body": "On Mon, 1 Jan 2001, Bob wrote:\n\n> Hi,\n\nInline answer.\n\n> more", "date_text": "2001-01-03 00:00:00Z"},
        {"message_id": "<4@x>", "body": "Top text.\n\n-----Original Message-----\nFrom: x\n\nold text", "date_text": None},
        {"message_id": "<5@x>", "body": "Only new."},
        {"message_id": "<1@x>", "body": f"Hi,\n\n{first}", "date_text": "2001-01-01 00:00:00Z"},
        {"body": "> all old"}, {"body": None}, {"body": ""},
    ]
    threads = ingest(spark, [(i, "t") for i in range(1, 10)])
    got = {r.row_idx: r.new_md5 for r in newtext.found(mail(spark, rows), threads, boxes(spark)).collect()}
    assert got == {2: key("New words of mine."), 3: key("Inline answer."), 4: key("Top text."), 7: key("")}


def test_notices(spark):
    """Copies of a mail in many threads stay new text; a line that ends unrelated mails of several senders is a notice."""
    copied = "A paragraph of some length that one person wrote and many others had sent to them."
    closing = "The last words of that mail, which every changed copy of it has at its very end too."
    line = "Registered seat of our firm is Harbour Road, entered in the register of companies."
    rows = [{"message_id": f"<c{i}@x>", "sender": "Carla Veltin", "body": copied} for i in range(30)]
    rows += [{"message_id": f"<d{i}@x>", "sender": f"{w} Veltin", "body": f"{copied} Changed {w}.\n\nThe middle part of the same mail that few people changed.\n\n{closing}"} for i, w in enumerate(WHO * 3)]
    first = len(rows)
    rows += [{"message_id": f"<n{i}@x>", "sender": f"{w} Pello", "body": f"Something of {w} alone about the {w.lower()} matter.\n\n{line}"} for i, w in enumerate(WHO)]
    threads = ingest(spark, [(i, f"t{i}") for i in range(1, len(rows) + 1)])
    got = {r.row_idx: r.new_md5 for r in newtext.found(mail(spark, rows), threads, boxes(spark)).collect()}
    assert got == {first + i: key(f"Something of {w} alone about the {w.lower()} matter.") for i, w in enumerate(WHO, 1)}


def test_leaks(spark):
    rng = random.Random(5)
    items = {i: [f"w{rng.randrange(900)}" for _ in range(24)] for i in range(20)}
    docs = {}
    for d in range(200):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(0, 300))]
        if d % 2:
            own = items[d % 20]
            n = rng.randrange(9, 24)
            s = rng.randrange(0, 24 - n + 1)
            at = rng.randrange(len(words) + 1)
            words[at:at] = own[s : s + n]
        docs[d] = ", ".join(words).upper()
    docs |= {300: None, 301: ""}
    grams = {tuple(w[k : k + 12]): i for i, w in items.items() for k in range(13)}
    want = set()
    for d, t in docs.items():
        w = WORDS.findall((t or "").lower())
        want |= {(d, grams[tuple(w[k : k + 12])]) for k in range(len(w) - 11) if tuple(w[k : k + 12]) in grams}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    test = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(99, None)], "item_id long, text string")
    for most in (2_000_000, 200):  # whole, and in parts
        assert {tuple(r) for r in leakage.leaked_items(df, test, max_index_rows=most).collect()} == want
    assert leakage.leaked_items(df.limit(0), test).collect() == []
    clean = spark.createDataFrame([(1, "no word of any item stands in this text"), (2, None)], "doc_id long, text string")
    assert leakage.leaked_items(clean, test).collect() == []
    assert leakage.leaked_items(clean.filter("text is null"), test).collect() == []


def test_mixture(spark):
    rng = random.Random(2)
    docs = [(i, " ".join("token" for _ in range(rng.randrange(20, 60))) + f" {i}", ["big", "mid", "small"][0 if i < 300 else 1 if i < 380 else 2]) for i in range(400)] + [(500, None, "big"), (501, "", "mid"), (502, "alone", None), (503, "word", "other")]
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.3, 2), ("small", 0.2, 4), ("none", 0.1, 9)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    written, report = mixture.mixture(df, targets)
    shares = {r.source: r for r in report.collect()}
    assert abs(shares["big"].reached_share - 4 / 9) < 0.03 and abs(shares["small"].reached_share - 2 / 9) < 0.03 and shares["none"].mixed_tokens == 0
    assert all(r.most_copies <= r.max_repeats for r in shares.values())
    assert {r.source for r in written.collect()} == {"big", "mid", "small"}
    capped = {r.source: r for r in mixture.mixture(df, targets, total_tokens=10**6)[1].collect()}
    assert all(capped[s].copies == capped[s].texts * capped[s].max_repeats for s in ("big", "mid", "small"))


def test_spans(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdé ") for _ in range(600)) for _ in range(30)]
    docs = dict(enumerate(base))
    for i in range(30, 60):
        n = rng.choice([150, 199, 200, 201, 320])
        s = rng.randrange(0, 600 - n)
        docs[i] = "".join(rng.choice("xyz") for _ in range(rng.randrange(100))) + base[i % 30][s : s + n] + "zz"
    docs |= {70: base[0], 71: base[0], 72: None, 73: "", 74: "short", 75: "short"}
    seen = {}
    for d, t in docs.items():
        for k in range(len(t or "") - 199):
            seen.setdefault(t[k : k + 200], set()).add(d)
    want = {p for v in seen.values() for p in itertools.combinations(sorted(v), 2)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {tuple(r) for r in spans.span_pairs(df).collect()} == want
    assert spans.span_pairs(df.limit(0)).collect() == []


def test_shared_amounts(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdé ") for _ in range(900)) for _ in range(3)]
    docs = {1: base[0], 2: "x" + base[0][100:320] + "yy" + base[0][300:700] + "z", 3: base[1], 4: base[1], 5: base[2], 6: base[2][:199] + "-", 7: None, 8: "", 9: base[1][:250] + base[2][500:760] + base[2][600:800]}
    seen = {}
    for d, t in docs.items():
        for k in range(len(t or "") - 199):
            seen.setdefault(t[k : k + 200], {}).setdefault(d, []).append(k)
    cover, whom = {d: set() for d in docs}, {d: set() for d in docs}
    for held in seen.values():
        for d, starts in held.items():
            if len(held) > 1:
                whom[d] |= held.keys() - {d}
                cover[d] |= {c for k in starts for c in range(k, k + 200)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id: (r.shared_chars, round(r.share, 9), r.partners) for r in spans.shared(df).collect()}
    assert got == {d: (len(cover[d]), round(len(cover[d]) / max(1, len(t or "")), 9), sorted(whom[d])) for d, t in docs.items()}


def test_empty_mail(spark):
    none = mail(spark, [{}]).limit(0)
    assert pii.found(none, contacts(spark)).collect() == [] and components.reply_groups(none).collect() == [] and encoding.found(none).collect() == []
    assert names.linked_entries(none, contacts(spark)).collect() == [] and newtext.found(none, ingest(spark, [(1, "t")]), boxes(spark)).collect() == []


def test_names_of_queries():
    assert {f"p{n}_found" for n in (2, 3, 4, 5, 6, 7, 8, 10)} | {"p9_shares"} <= set(queries.QUERIES)


def test_giant_component_without_a_hub_is_peeled(spark):
    """Random edges: nearly all vertices hang together, and none is a hub."""
    draw = random.Random(5)
    edges = [(draw.randrange(3000), draw.randrange(3000)) for _ in range(6000)] + [(5001, 5000), (5002, 5001)]
    df = spark.createDataFrame(edges, "u long, v long")
    rest, peeled = components._peel(df.filter("u <> v"), 3, 1.25)
    assert peeled.count() > 2500 and rest.count() < 100  # anti-joined away, small ones left
    parent = list(range(5003))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert {tuple(r) for r in components.components(df).collect()} == {(x, root(x)) for x in linked}


def test_long_chain_is_contracted(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    rest, peeled = components._peel(df, 3, 1.25)
    assert 0 < rest.count() < 60 and peeled.count() < 20
    assert {tuple(r) for r in components.components(df).collect()} == {(i, 0) for i in range(61)}


def test_short_and_repeated_names(spark):
    directory = contacts(spark, (("Robert Li", "person"), ("Ann Roberts", "person")))
    rows = [{"sender": "Bob Li <robert@firm.example>"}, {"sender": "Bob Lu <robert@firm.example>"}, {"sender": "Robert Roberts <x@y.example>"}, {"sender": "RLi"}, {"sender": "A. Roberts <ann.roberts@firm.example>"}, {"sender": "A. Roberts <albert.roberts@firm.example>"}]
    got = {tuple(r) for r in names.linked_entries(mail(spark, rows), directory).collect()}
    assert got == {(1, "sender", 1), (4, "sender", 1)}


def test_names_of_three_parts(spark):
    directory = contacts(spark, (("Anna Silver", "person"), ("Maria Kelisemire", "person"), ("Peter Schmidt", "person")))
    body = "Yesterday Anna Maria Schmidt called.\nRegards from Maria P. Schmidt and Anna Maria.\nAnna Maria Monday Report"
    got = {r.value_key for r in pii.found(mail(spark, [{"body": body}]), directory).collect()}
    assert "annamariaschmidt" in got and "mariapschmidt" in got and not got & {"mariaschmidt", "annamariamonday", "annamariamondayreport"}


def test_name_filter_lets_all_given_names_pass(spark):
    words = [f"name{i}" for i in range(2000)]
    bits, mask = pii._name_filter(spark.createDataFrame([(w,) for w in words], "token string")), (1 << pii.FILTER_BITS) - 1

    def held(word):
        h = xxhash.xxh64_intdigest(word, seed=42)
        return all(bits[p >> 3] >> (p & 7) & 1 for p in (h & mask, h >> pii.FILTER_BITS & mask))

    assert all(map(held, words)) and sum(held(f"other{i}") for i in range(2000)) < 20


def test_readings_by_translate(spark):
    """The readings of a page undo the page, in part where the rest is no symbol of it, and as often as it was applied."""
    once = "é€’".encode().decode("cp1252")
    runs = [once, once.encode().decode("cp1252"), "é".encode().decode("mac_roman"), "çã", "├──"]
    read = encoding._readings(spark.createDataFrame([(r,) for r in runs], "run string"), ["cp1252", "mac_roman"])
    got = {(r.run, r.page, len(r.steps)): r.restored for r in read.collect()}
    assert got[(once, "cp1252", 1)] == "é€’" and got[(runs[1], "cp1252", 2)] == "é€’" and got[(runs[2], "mac_roman", 1)] == "é"
    assert {k for k in got if k[0] in ("çã", "├──")} == {("çã", "", 0), ("├──", "", 0)}
