"""Variant spellings of names typed by people: a prefix-filtered set-similarity join on token q-grams, verified by soft
weighted token similarity in which rare tokens count more.

Each distinct typed name is reduced to tokens. Tokens are joined with the directory's rarest token of each entry (the family
name of a person, the proper word of an organisation) on the prefix of their q-grams in order of rarity, which finds every
pair above the Jaccard threshold. A pair of name and entry is then scored: every token of the entry takes its best match among
the typed tokens (equal, one edit, nickname, initial), weighted by its rarity; typed tokens that match nothing weigh against
it. The best entry wins; between equals the address beside the name decides, else nothing is said.

Defined results: null and empty entries and bare addresses name nobody; repeated entries of a row count once; an empty mail
table or directory gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.sources.tables import checkpointed

# Short forms of given names.
NICKNAMES = {
    "alexander": ["alex", "al", "sandy"], "andrew": ["andy", "drew"], "anthony": ["tony"], "benjamin": ["ben"], "catherine": ["cathy", "kate", "cate"], "charles": ["charlie", "chuck", "chas"],
    "christopher": ["chris", "kit"], "daniel": ["dan", "danny"], "david": ["dave", "davy"], "deborah": ["deb", "debbie", "debra"], "donald": ["don"], "dorothy": ["dot", "dotty"],
    "edward": ["ed", "eddie", "ted", "ned"], "elizabeth": ["liz", "beth", "betty", "lizzie", "eliza", "betsy"], "eugene": ["gene"], "francis": ["frank"], "frederick": ["fred", "freddie"],
    "gerald": ["gerry", "jerry"], "gregory": ["greg"], "harold": ["harry", "hal"], "henry": ["hank", "harry"], "jacob": ["jake"], "james": ["jim", "jimmy", "jamie"], "jeffrey": ["jeff"],
    "jennifer": ["jen", "jenny", "jenn"], "john": ["jack", "johnny"], "jonathan": ["jon"], "joseph": ["joe", "joey"], "joshua": ["josh"], "katherine": ["kate", "kathy", "katie", "kay", "kat"], "kenneth": ["ken", "kenny"],
    "lawrence": ["larry", "laurie"], "leonard": ["len", "leo"], "margaret": ["maggie", "meg", "peggy", "marge", "madge"], "matthew": ["matt"], "michael": ["mike", "mick", "mickey"], "nathaniel": ["nat", "nate"], "nicholas": ["nick"],
    "pamela": ["pam"], "patricia": ["pat", "patty", "tricia", "trish"], "patrick": ["pat", "paddy"], "peter": ["pete"], "philip": ["phil"], "raymond": ["ray"], "rebecca": ["becky", "becca"], "richard": ["rick", "dick", "rich", "richie", "ricky"],
    "robert": ["bob", "rob", "bobby", "robbie", "bert"], "ronald": ["ron"], "samantha": ["sam"], "samuel": ["sam", "sammy"], "sandra": ["sandy"], "stephen": ["steve"], "steven": ["steve", "stevie"], "susan": ["sue", "susie", "suzy"],
    "theodore": ["ted", "theo"], "theresa": ["terry", "tess", "terri", "tessa"], "thomas": ["tom", "tommy"], "timothy": ["tim"], "victoria": ["vicky", "tori"], "vincent": ["vince"], "walter": ["walt"], "william": ["bill", "will", "billy", "willy", "liam"],
}
# Short forms of words in the names of firms.
FIRM_WORDS = {
    "inc": "incorporated", "corp": "corporation", "co": "company", "ltd": "limited", "mktg": "marketing", "mkt": "marketing", "trans": "transmission", "intl": "international", "int": "international", "svcs": "services", "svc": "services", "serv": "services",
    "ptnrs": "partners", "pwr": "power", "nrg": "energy", "engy": "energy", "stg": "storage", "stor": "storage", "term": "terminals", "terms": "terminals", "pipe": "pipeline", "pl": "pipeline", "trdg": "trading", "trad": "trading",
}
# Letters with marks and their plain forms.
MARKED, PLAIN = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿšžœðþ", "aaaaaaaceeeeiiiinoooooouuuuyyszodt"
_Q = 2


def plain(text: Column) -> Column:
    return F.translate(F.lower(text), MARKED, PLAIN)


def entry_name(entry: Column) -> Column:
    """The name of an entry without its address and outer quotes; '' for a bare address."""
    e = F.trim(F.coalesce(entry, F.lit("")))
    inner = F.regexp_extract(e, r"^[^\s()<>]+@[^\s()<>]+\s*\((.*)\)$", 1)
    before = F.regexp_extract(e, r"^(.*?)\s*<[^<>]*>$", 1)
    bare = e.rlike(r"^[<]?[^\s()<>/=]+@[^\s()<>]+[>]?$")
    name = F.when(inner != "", inner).when(e.rlike(r"<[^<>]*>$"), before).when(bare, F.lit("")).otherwise(e)
    return F.trim(F.regexp_replace(F.trim(name), r"""^["']+|["']+$""", ""))


def entry_address(entry: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(entry, F.lit("")), r"([^\s()<>]+@[^\s()<>\"]+)", 1))


def name_tokens(name: Column) -> Column:
    """Plain lower-case tokens; directory paths (CN=name/OU=unit, name/unit@domain) give the name alone; the rest of firms' short words spelled out."""
    common = F.regexp_extract(name, r"(?i)^cn=([^/@]+)", 1)
    bare = F.when(common != "", common).otherwise(F.regexp_replace(name, r"[/@].*$", ""))
    words = F.regexp_extract_all(plain(bare), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    firm = F.create_map(*[F.lit(x) for k, v in FIRM_WORDS.items() for x in (k, v)])
    return F.filter(F.transform(words, lambda w: F.coalesce(firm[w], w)), lambda w: ~w.isin("the", "and"))


def _grams(token: Column) -> Column:
    padded = F.concat(F.lit("_"), token, F.lit("_"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - (_Q - 1)), lambda i: F.substring(padded, i, F.lit(_Q))))


def token_join(left: DataFrame, right: DataFrame, jaccard: float) -> DataFrame:
    """(token, target): pairs of tokens whose q-gram sets reach the Jaccard similarity, found by prefix filtering."""
    a = left.select("token").distinct().withColumn("grams", _grams(F.col("token")))
    b = right.select(F.col("token").alias("target")).distinct().withColumn("grams", _grams(F.col("target")))
    # rarity in the directory, of which the gram alphabet bounds the size
    df = b.select(F.explode("grams").alias("gram")).groupBy("gram").count()

    def prefixes(side: DataFrame, key: str) -> DataFrame:
        ranked = side.select(key, F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(df, "gram", "left")
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "gram")))
        own = ranked.groupBy(key, "n").agg(order.alias("o"))  # the grams of one token
        keep = F.col("n") - F.ceil(F.lit(jaccard) * F.col("n")).cast("int") + 1
        return own.select(key, F.explode(F.slice(F.transform("o", lambda g: g["gram"]), 1, keep)).alias("gram"))

    # narrow rows, but joining and comparing them is the work: spread over the session's partitions
    spread = lambda df: df.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "token")
    pairs = spread(spread(prefixes(a, "token")).join(prefixes(b, "target"), "gram").select("token", "target").distinct())
    x, y = _grams(F.col("token")), _grams(F.col("target"))
    common = F.size(F.array_intersect(x, y))
    return pairs.filter(common >= jaccard * (F.size(x) + F.size(y) - common))


def _one_edit(a: Column, b: Column) -> Column:
    """At most one insertion, deletion, substitution or swap of neighbours."""
    swapped = (F.length(a) == F.length(b)) & (F.levenshtein(a, b) == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (F.levenshtein(a, b) <= 1) | swapped


def _likeness(typed: Column, own: Column, nick: Column) -> Column:
    """Similarity of a typed token to a directory token: equal 1, short form 0.95, one edit 0.9, initials 0.7."""
    short = F.array_contains(F.coalesce(nick[own], F.array().cast("array<string>")), typed)
    near_short = F.exists(F.coalesce(nick[own], F.array().cast("array<string>")), lambda s: (F.length(s) > 3) & (F.length(typed) > 3) & _one_edit(typed, s))
    initial = (F.length(typed) <= 2) & (F.substring(typed, 1, 1) == F.substring(own, 1, 1))
    edit = (F.length(own) >= 4) & (F.length(typed) >= 3) & _one_edit(typed, own)
    return F.when(typed == own, 1.0).when(short, 0.95).when(edit, 0.9).when(near_short, 0.8).when(initial, 0.7).otherwise(0.0)


def linked_names(names: DataFrame, contacts: DataFrame, jaccard: float = 0.3, accept: float = 0.75) -> DataFrame:
    """(name, address, contact_id) of the distinct typed names (name, address) that mean one contact."""
    nick = F.create_map(*[x for k, v in NICKNAMES.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    directory = contacts.select("contact_id", "full_name", "contact_kind", F.lower("email").alias("email"), name_tokens(F.col("full_name")).alias("own")).filter(F.size("own") > 0)
    counts = directory.select(F.explode("own").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    size = directory.agg(F.count(F.lit(1)).alias("all"))
    weighted = directory.select("contact_id", F.posexplode("own").alias("pos", "token")).join(counts, "token").join(F.broadcast(size))
    weighted = weighted.withColumn("weight", F.log(1 + F.col("all") / F.col("df")))
    # an entry's tokens with their weights, the rarest first; later ones of equal rarity first, as family names follow
    entry = weighted.groupBy("contact_id").agg(F.sort_array(F.collect_list(F.struct("weight", "pos", "token")), asc=False).alias("tokens"))
    entry = entry.join(directory.select("contact_id", "full_name", "contact_kind", "email"), "contact_id").withColumn("family", F.when(F.col("contact_kind") == "person", F.element_at(F.sort_array(F.transform("tokens", lambda t: F.struct(t["pos"], t["token"])), asc=False), 1)["token"]).otherwise(F.col("tokens")[0]["token"]))

    # the distinct spellings, far fewer than the mail, and all that follows is about them
    typed = checkpointed(names.select("name", "address").distinct().withColumn("typed", name_tokens(F.col("name"))).filter(F.size("typed") > 0))
    # single letters are initials; a lone token may be a login, an initial written before the family name
    part = F.transform(F.filter("typed", lambda t: F.length(t) > 1), lambda t: F.struct(t.alias("token"), t.alias("part"), F.lit(False).alias("login")))
    lone = F.get("typed", F.lit(0))
    login = F.when((F.size("typed") == 1) & (F.length(lone) > 2), F.array(F.struct(lone.alias("token"), F.expr("substring(typed[0], 2)").alias("part"), F.lit(True).alias("login"))))
    spelled = typed.select("name", "address", "typed", F.explode(F.concat(part, F.coalesce(login, F.array().cast("array<struct<token:string,part:string,login:boolean>>")))).alias("s")).select("name", "address", "typed", "s.token", "s.part", "s.login")
    joined = token_join(spelled.select(F.col("part").alias("token")), entry.select(F.col("family").alias("token")), jaccard)
    # an edit of a two-letter name is another name
    close = F.when(F.least(F.length("token"), F.length("target")) > 2, _one_edit(F.col("token"), F.col("target"))).otherwise(F.col("token") == F.col("target"))
    pairs = checkpointed(joined.filter(close).select(F.col("token").alias("part"), "target"))
    found = spelled.join(pairs, "part").filter(~F.col("login") | (F.col("part") == F.col("target")))
    # of the tokens of a spelling that are like a family name the likest
    likest = found.groupBy("name", "address", "typed", "target").agg(F.min(F.struct(F.levenshtein("part", "target").alias("far"), "login", "token")).alias("l"))
    candidates = likest.join(entry, F.col("family") == F.col("target")).select("name", "address", "typed", "l.token", "contact_id", "full_name", "contact_kind", "email", "tokens", "family")
    # narrow rows, but scoring them is the costly part: spread over the session's partitions
    candidates = candidates.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name", "address")

    person = F.col("contact_kind") == "person"
    is_login = person & (F.size("typed") == 1) & (F.col("token") != F.col("family"))
    given = F.filter("tokens", lambda t: t["token"] != F.col("family"))
    rest = F.when(is_login, F.array(F.substring("token", 1, 1))).otherwise(F.filter("typed", lambda t: t != F.col("token")))
    candidates = candidates.withColumns({"given": given, "rest": rest})
    best = lambda own: F.array_max(F.concat(F.array(F.lit(0.0)), F.transform("rest", lambda t: _likeness(t, own, nick))))
    plus = lambda items, f: F.aggregate(items, F.lit(0.0), lambda s, t: s + f(t))
    family_like = F.when(is_login | (F.col("token") == F.col("family")), 1.0).otherwise(0.9)
    family_weight = F.element_at(F.filter("tokens", lambda t: t["token"] == F.col("family")), 1)["weight"]
    # what was typed and means nothing here: single letters may be middle initials
    strange = F.size(F.filter("rest", lambda t: (F.length(t) > 2) & ~F.exists("given", lambda g: _likeness(t, g["token"], nick) > 0)))
    candidates = candidates.withColumns(
        {
            "given_like": plus("given", lambda t: t["weight"] * best(t["token"])) / F.greatest(plus("given", lambda t: t["weight"]), F.lit(1e-9)),
            "hits": F.size(F.filter("given", lambda g: best(g["token"]) > 0)),
            "family_like": family_like,
            "strange": strange,
            "exact_address": F.col("address") == F.col("email"),
            "same_box": F.regexp_extract("address", "^([^@]+)@", 1) == F.regexp_extract("email", "^([^@]+)@", 1),
            "own_box": F.exists(F.split(plain(F.regexp_extract("address", "^([^@]+)@", 1)), r"[^\p{L}\p{N}]+"), lambda b: b == F.col("family")),
        }
    )
    score = (family_weight * F.col("family_like") + F.col("given_like") * F.greatest(plus("given", lambda t: t["weight"]), F.lit(1e-9))) / (family_weight + plus("given", lambda t: t["weight"]) + F.col("strange") * family_weight)
    # firms drop words: one other word must match and none may be strange
    firm_score = F.when((F.col("strange") == 0) & (F.col("hits") >= 1), 0.8 + 0.1 * F.col("family_like") * F.col("given_like"))
    scored = candidates.withColumn("score", F.when(person, F.when(F.col("given_like") >= 0.69, score)).otherwise(firm_score))
    # a mailbox that spells out the family name is personal: one of someone else overrules an initial
    scored = scored.filter((F.col("score") >= accept) & ~(person & (F.col("given_like") < 0.75) & F.col("own_box") & ~F.col("same_box")))
    ranked = scored.withColumn("rank", F.struct(F.round(F.col("family_like") + F.col("given_like"), 3).alias("s"), F.col("exact_address").cast("int").alias("e")))
    best_of = ranked.groupBy("name", "address").agg(F.max("rank").alias("rank"))
    top = ranked.join(best_of, ["name", "address", "rank"]).groupBy("name", "address").agg(F.count(F.lit(1)).alias("n"), F.min("contact_id").alias("contact_id"), F.min("full_name").alias("full_name"))
    return top.filter("n = 1 and name <> full_name").select("name", "address", "contact_id")


def linked_entries(mail: DataFrame, contacts: DataFrame, **settings) -> DataFrame:
    """(row_idx, field, contact_id): the fields with an entry that names the contact in another spelling."""
    one = F.array(F.struct(F.lit("sender").alias("field"), F.col("sender").alias("entry")))
    more = F.transform(F.coalesce("cc", F.array().cast("array<string>")), lambda e: F.struct(F.lit("cc").alias("field"), e.alias("entry")))
    entries = mail.select("row_idx", F.explode(F.concat(one, more)).alias("e")).select("row_idx", "e.field", entry_name(F.col("e.entry")).alias("name"), entry_address(F.col("e.entry")).alias("address")).filter("name <> ''")
    links = linked_names(entries, contacts, **settings)
    return entries.join(links, ["name", "address"]).select("row_idx", "field", "contact_id").distinct()
