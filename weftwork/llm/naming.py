"""Variant spellings of names typed by people, by noisy-channel attribution.

A spelling is reduced to a key (family name, or an organisation's own word)
and a modifier (given name, or line of business). Each spelling has candidate
canonical forms, and each candidate a posterior in logarithms: how much more
often it is written than the spelling (the prior), plus the likelihood of the
channel that turns one into the other. The channels: a typo of the key or of
the modifier (insertion, deletion, substitution, transposition, lost accent,
digit for letter), a nickname, an initial, an abbreviation, parts reordered,
titles, legal forms and remarks. "A name of its own" is the competing
hypothesis; what speaks for it is company: other members of the family, other
families with the given name, a dictionary of given names. Each spelling is
attached to its one candidate of greatest posterior, or stays its own.

All odds are ratios of counts, so a table repeated whole gives the same links.

Candidates come from equi-joins on blocking keys (all one-letter deletions,
nickname classes, initials). Blocks of typos keep every spelling they hold: at
most one an inserted letter, whatever the number of rows; the distance test and
the choice come after. The other blocks keep their best spelling.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftwork.session import durable

# Full given names and the short forms in common use.
NICKNAMES = {
    "abigail": "abby abbie gail", "alexander": "alex xander sandy al lex", "alexandra": "alex sandra lexi", "alfred": "alf alfie fred", "andrew": "andy drew",
    "anthony": "tony ant", "arthur": "art artie", "barbara": "barb babs barbie", "benjamin": "ben benny benji", "bernard": "bernie", "bridget": "biddy",
    "caroline": "carrie caro", "catherine": "cathy cath kate katie cat", "charles": "charlie chuck chas", "charlotte": "lottie charlie", "christina": "chris tina chrissy",
    "christine": "chris tina chrissy", "christopher": "chris kit topher", "cynthia": "cindy", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie debby",
    "dominic": "dom", "donald": "don donny", "dorothy": "dot dottie dolly dory", "douglas": "doug dougie", "edward": "ed eddie ned ted teddy", "eleanor": "nell ellie nora ella lenny",
    "elizabeth": "liz lizzie beth betty eliza libby bess betsy lisa", "emily": "em emmy", "eugene": "gene", "frances": "fran frankie", "francis": "frank fran", "franklin": "frank",
    "frederick": "fred freddie freddy rick", "gabriel": "gabe", "gerald": "gerry jerry", "geoffrey": "geoff", "gregory": "greg", "gwendolyn": "gwen wendy", "harold": "harry hal",
    "helen": "nell nellie", "henry": "harry hank hal", "isabella": "bella izzy isa", "jacob": "jake", "james": "jim jimmy jamie", "jacqueline": "jackie", "jeffrey": "jeff",
    "jennifer": "jen jenny jenn", "jessica": "jess jessie", "john": "jack johnny jon", "jonathan": "jon jonny", "joseph": "joe joey jo", "josephine": "jo josie", "joshua": "josh",
    "judith": "judy", "katherine": "kate kathy katie kat kit kath", "kenneth": "ken kenny", "lawrence": "larry laurie", "leonard": "len lenny leo", "lillian": "lily lil",
    "louis": "lou", "margaret": "peggy maggie meg marge greta peg margie", "martin": "marty", "matthew": "matt matty", "megan": "meg", "michael": "mike mick mickey mikey",
    "nathaniel": "nate nat nathan", "nathan": "nate nat", "nicholas": "nick nicky", "nicole": "nicky nikki", "pamela": "pam", "patricia": "pat patty tricia trish patsy",
    "patrick": "pat paddy", "penelope": "penny pen", "peter": "pete", "philip": "phil pip", "rachel": "rach", "raymond": "ray", "rebecca": "becca becky beck", "richard": "rick dick rich richie ricky",
    "robert": "bob rob bobby robbie bert", "roderick": "rod", "roger": "rodge", "ronald": "ron ronnie", "rosalind": "roz ros rosie", "russell": "russ", "samantha": "sam sammy",
    "samuel": "sam sammy", "sarah": "sally sadie", "stanley": "stan", "stephen": "steve stevie", "steven": "steve stevie", "susan": "sue susie suzy", "theodore": "ted theo teddy",
    "theresa": "terry tess tessa", "thomas": "tom tommy", "timothy": "tim timmy", "valerie": "val", "victoria": "vicky tori vickie", "vincent": "vince vinny vin", "virginia": "ginny",
    "walter": "walt wally", "william": "bill will billy willy liam", "zachary": "zach zack zac",
}

# Given names beside those that have nicknames.
GIVEN = """agnieszka álvaro anaïs bogdan björn carmen dmitri esperanza fatima françoise günther hélène hiroko ibrahim ingrid jürgen kwame linnea łukasz mara mehmet nadia
noor oksana olumide paolo priya quentin renée soledad søren tariq tomás ursula vikram wendeline xiomara yusuf yvette zoë anna maria eva laura julia sofia lena marie pierre jean luc
michel antoine sophie claire camille juan pedro pablo luis javier miguel ana lucía elena marta hans peter klaus jürg stefan thomas markus andreas heike petra sabine monika
joan jane janet jean joanna johanna hannah hanna alan allan alice alina amanda angela anja antonia antonio arno astrid carl carla carlo carlos celia christian clara dana daniela dario denis diana dora elisa emma erik
erika felix frida georg gerd gloria grace greta ida irene iris jana jan joao johan jonas jorge josé julian karin karl katja lara leon lisa lucas lukas luisa manuel marcel mario mark mary mia mira nina noah nora otto
oscar paul paula pauline petr rafael ralf ramon raul rita robin rosa ruth sandro sara sergio silvia simon simone sonja stella susanne sylvia tanja tina toni ulrich uwe vera viktor wilma yves
mohammed ahmed ali omar aisha wei li chen yuki kenji sven lars nils olga ivan natasha giulia marco luca""".split()

# Words beside a person's or a firm's name that are no part of it.
TITLES = "dr prof professor mr mrs ms miss mx sir herr frau mme m mlle sr sra srta don dona monsieur madame señor señora jr snr jnr esq phd md ii iii".split()
LEGAL_FORMS = """gmbh mbh gesellschaft inc incorporated corp corporation ltd limited pty proprietary pl llc llp plc co company ag sa sarl srl bv nv oy ab
and partners ptnrs partner the head office hq group holding holdings""".split()

#: Likelihoods of the channels, against a spelling that is a name of its own: a typo of the key, of the modifier, a nickname and its full name, two nicknames of one name, an initial, no modifier at all.
CHANNELS = {"key": 1.8, "modifier": 1.8, "nickname": 0.5, "nicknames": 0.2, "initial": 0.3, "bare": 0.3}
#: A typo of the key whose modifiers are not the same but a nickname's or an initial's is so much less likely, a step.
LOOSE = 4.0
#: The odds of a typo are so many times less for each letter that a key has under five: short names are near to others by chance.
SHORT_ODDS = 5.0
#: A typo seldom makes another listed given name, or one that differs in its last vowel only (Maria, Mario).
LISTED_ODDS = 1 / 40
#: A given name this many times rarer than its neighbour over all families is read as that, if it is not listed.
MENDED_RATIO = 4
#: Small letters with an accent and those without.
FOLDED = {c: unicodedata.normalize("NFKD", c)[0] for c in map(chr, range(0xC0, 0x250)) if c == c.lower() and unicodedata.normalize("NFKD", c)[0] != c} | dict(zip("øłđıð", "oldid"))


def fold(text: Column) -> Column:
    """Lower case without accents; digits that stand for letters inside a word are read as those."""
    out = F.translate(F.lower(text), "".join(FOLDED), "".join(FOLDED.values()))
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("\\p{M}", "")):
        out = F.regexp_replace(out, a, b)
    for a, b in (("0", "o"), ("1", "l"), ("3", "e"), ("5", "s")):
        out = F.regexp_replace(out, f"(?<=[a-z]){a}(?=[a-z])|(?<=[a-z][a-z]){a}|\\b{a}(?=[a-z][a-z])", b)
    return out


def fold_plain(word: str) -> str:
    """``fold`` of one word of letters."""
    return "".join(FOLDED.get(c, c) for c in word.lower())


def words_of(text: Column, kind: Column) -> tuple[Column, Column]:
    """(words, reversed): the words that make a name, and whether a comma puts the last part first."""
    bare = F.regexp_replace(fold(text), r"\([^)]*\)|, *head office *$", " ")
    person = F.split(F.regexp_replace(F.regexp_replace(bare, r"['’\-]", ""), r"[^a-z0-9]+", " "), " ")
    firm = F.split(F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"p/l|g\. ?m\. ?b\. ?h\.?", " gmbh "), r"[.'’]", ""), r"[^a-z0-9]+", " "), " ")
    drop = lambda stop: lambda w: (w != "") & ~w.isin(stop)
    said = F.filter(person, drop([t for t in TITLES if len(t) > 1]))
    whole = F.filter(said, lambda w: F.length(w) > 1)
    # initials count only where they are all that stands beside the family name
    words = F.when(kind == "person", F.when(F.size(whole) >= 2, whole).otherwise(said)).otherwise(F.filter(firm, drop(LEGAL_FORMS)))
    comma = F.when(kind == "person", bare.rlike(r"^\s*[^,]+,\s*[^,\s]")).otherwise(bare.rlike(r"^\s*[^,\s]+,\s*[^,\s]"))
    return words, comma


def deletions(word: Column, over: int = 3) -> Column:
    """The word and, if it has more than ``over`` letters, all that are left when one letter goes: two words one typo apart share one."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) > over, cut).otherwise(F.array().cast("array<string>"))))


def one_typo(a: Column, b: Column) -> Column:
    swapped = (F.length(a) == F.length(b)) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    apart = F.levenshtein(a, b)
    return (apart <= 1) | ((apart == 2) & swapped)


def another_name(a: Column, b: Column, kind: Column) -> Column:
    """Whether a person's given name ``a`` is listed, or differs from ``b`` in its last vowel only, as the forms of one name for men and women do."""
    stem = lambda c: F.expr("substring({0}, 1, length({0}) - 1)".format(c)) if isinstance(c, str) else F.substring(c, F.lit(1), F.length(c) - 1)
    last = lambda c: F.substring(c, -1, 1)
    turned = (F.length(a) == F.length(b)) & (stem(a) == stem(b)) & last(a).isin("a", "e", "i", "o", "y") & last(b).isin("a", "e", "i", "o", "y")
    listed = a.isin(sorted({*NICKNAMES, *(fold_plain(g) for g in GIVEN)}))
    return (kind == "person") & (listed | turned)


def _nickname_rows(spark):
    """(short, full): bounded by the table above."""
    return spark.createDataFrame([(s, full) for full, shorts in NICKNAMES.items() for s in shorts.split()], "mod string, full string")


def _spellings(registry: DataFrame) -> DataFrame:
    """(id, kind, source, key, mod, merged): of each row, what raw_value (else normalised_value) and display_name spell."""
    kind = F.lower(F.trim("entity_type"))
    kind = F.when(kind.isin("person", "people"), "person").when(kind.isin("organisation", "organization", "org", "company"), "organisation")
    base = registry.select(
        "id", kind.alias("kind"), F.col("merged_into_id").alias("merged"),
        F.explode(F.array(
            F.struct(F.lit("raw").alias("source"), F.coalesce(F.nullif(F.trim("raw_value"), F.lit("")), "normalised_value", "display_name").alias("said")),
            F.struct(F.lit("display").alias("source"), F.col("display_name").alias("said")),
        )).alias("s"),
    ).where(F.col("kind").isNotNull()).select("id", "kind", "merged", "s.source", "s.said")
    words, comma = words_of(F.col("said"), F.col("kind"))
    base = base.select("id", "kind", "merged", "source", words.alias("w"), comma.alias("comma")).where(F.size("w") >= 1)
    first, last = F.col("w")[0], F.when(F.size("w") > 1, F.element_at("w", -1))
    # a: the place of given names and of firms' own words
    base = base.select("id", "kind", "merged", "source", F.when(F.col("comma"), last).otherwise(first).alias("a"), F.when(F.col("comma"), first).otherwise(last).alias("b"))
    votes = (
        base.where("source = 'raw'").select("kind", F.explode(F.array(F.struct(F.col("a").alias("w"), F.lit(1).alias("as_a")), F.struct(F.col("b").alias("w"), F.lit(0).alias("as_a")))).alias("v"))
        .where(F.col("v.w").isNotNull()).groupBy("kind", F.col("v.w").alias("w")).agg(F.log((F.sum("v.as_a") + 0.5) / (F.count("*") - F.sum("v.as_a") + 0.5)).alias("odds"))
    )
    scored = (
        base.join(votes.select("kind", F.col("w").alias("a"), F.col("odds").alias("odds_a")), ["kind", "a"], "left")
        .join(votes.select("kind", F.col("w").alias("b"), F.col("odds").alias("odds_b")), ["kind", "b"], "left")
    )
    initial_b = (F.length("b") == 1) & (F.length("a") > 1)
    turned = F.when(F.length("a") == 1, False).when(initial_b, True).otherwise(F.coalesce(F.col("odds_b"), F.lit(0.0)) > F.coalesce(F.col("odds_a"), F.lit(0.0)))
    turned = turned & F.col("b").isNotNull()
    head, tail = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))
    person = F.col("kind") == "person"
    return scored.select(
        "id", "kind", "source", "merged", F.when(person, F.coalesce(tail, head)).otherwise(head).alias("key"), F.when(person, F.when(tail.isNotNull(), head)).otherwise(tail).alias("mod")
    )


def _best(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Of each block the spelling of greatest count (ties: the last in order), by one aggregation."""
    return rows.groupBy(*by).agg(F.max(F.struct("n", *columns)).alias("_best")).select(*by, *[F.col(f"_best.{c}").alias(f"to_{c}") for c in ["n", *columns]])


def attribute(registry: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(places, parents, said): places (id, kind, key, mod) puts each row on a spelling; parents (kind, key, mod, to_key, to_mod, channel, posterior) has the one attachment of each spelling that has any.

    said are pairs of spellings that the registry itself calls one: a row's
    merged_into_id, and a display name that is near to what was typed.
    """
    spark = registry.sparkSession
    said = durable(_spellings(registry), "p3-spellings")
    raw, shown = said.where("source = 'raw'"), said.where("source = 'display'").select("id", F.col("key").alias("d_key"), F.col("mod").alias("d_mod"))
    # a display name counts as a spelling of the row only if it is near to the raw one; labels such as a kinship word are not
    near = one_typo(F.col("key"), F.col("d_key")) & F.col("d_mod").isNotNull()
    both = raw.join(shown, "id", "left").withColumn("near", F.coalesce(near, F.lit(False)))
    vague = F.col("mod").isNull() | (F.length("mod") == 1)
    better = F.col("near") & vague & (F.length("d_mod") > 1)
    both = durable(
        both.select(
            "id", "kind", "merged", F.when(better, F.col("d_key")).otherwise(F.col("key")).alias("key"),
            F.coalesce(F.when(better, F.col("d_mod")).otherwise(F.col("mod")), F.lit("")).alias("mod"),
            F.when(F.col("near") & ~vague & (F.length("d_mod") > 1) & ((F.col("key") != F.col("d_key")) | (F.col("mod") != F.col("d_mod"))), F.struct(F.col("d_key").alias("key"), F.col("d_mod").alias("mod"))).alias("other"),
        ),
        "p3-places",
    )
    links = both.where(F.col("other").isNotNull()).select("kind", "key", "mod", F.col("other.key").alias("to_key"), F.col("other.mod").alias("to_mod"))
    full = lambda c: F.length(c) > 1
    target = both.select(F.col("id").alias("merged"), F.col("kind").alias("_kind"), F.col("key").alias("to_key"), F.col("mod").alias("to_mod"))
    merged = both.where(F.col("merged").isNotNull() & full("mod")).join(target, "merged").where((F.col("kind") == F.col("_kind")) & full("to_mod")).select("kind", "key", "mod", "to_key", "to_mod")

    # counts: rows on a spelling, and display names as further evidence of it
    nodes = (
        both.select("kind", "key", "mod", F.lit(1.0).alias("w")).unionByName(links.select("kind", F.col("to_key").alias("key"), F.col("to_mod").alias("mod"), F.lit(0.5).alias("w")))
        .groupBy("kind", "key", "mod").agg(F.sum("w").alias("n"))
    )
    key_counts = nodes.groupBy("kind", "key").agg(F.sum("n").alias("n_key"))
    nodes = durable(nodes.join(key_counts, ["kind", "key"]), "p3-nodes")

    # modifiers, over all keys: rare ones one typo from a frequent one
    mods = nodes.where(full("mod")).groupBy("kind", "mod").agg(F.sum("n").alias("n"))
    mod_cuts = mods.select("kind", "mod", "n", F.explode(deletions(F.col("mod"))).alias("cut"))
    mended = (
        mod_cuts.join(mod_cuts.select("kind", "cut", F.col("n").alias("to_n"), F.col("mod").alias("to_mod")), ["kind", "cut"])
        .where((F.col("to_n") >= MENDED_RATIO * F.col("n")) & (F.length("mod") >= 3) & one_typo(F.col("mod"), F.col("to_mod")) & ~another_name(F.col("mod"), F.col("to_mod"), F.col("kind")))
        .groupBy("kind", "mod").agg(F.max(F.struct("to_n", "to_mod")).alias("m")).select("kind", "mod", F.col("m.to_mod").alias("mended"))
    )
    # lines of business: an abbreviation begins with the same letter, is shorter and has its letters in that order
    firms = mods.where("kind = 'organisation'")
    frequent = firms.where(F.length("mod") >= 5).select(F.col("mod").alias("long"), F.col("n").alias("long_n"))
    in_order = F.expr("long rlike concat('^', array_join(transform(filter(split(mod, ''), c -> c <> ''), c -> concat(c, '[a-z]*')), ''), '$')")
    # joined on the first three letters of the short form: those of the long one that begin with its first letter, in order
    heads = F.transform(F.sequence(F.lit(2), F.length("long")), lambda i: F.transform(F.sequence(i, F.length("long")), lambda j: F.concat(
        F.substring("long", 1, 1), F.substring(F.col("long"), i, F.lit(1)), F.when(j > i, F.substring(F.col("long"), j, F.lit(1))).otherwise(F.lit("")))))
    frequent = frequent.select("long", "long_n", F.explode(F.array_distinct(F.flatten(heads))).alias("f"))
    shortened = (
        firms.where(F.length("mod") >= 2).withColumn("f", F.substring("mod", 1, 3)).join(frequent, "f").where((F.length("mod") < F.length("long")) & (F.col("long_n") > F.col("n")) & in_order)
        .groupBy("kind", "mod").agg(F.max(F.struct("long_n", "long")).alias("m")).select("kind", "mod", F.col("m.long").alias("stands_for"))
    )
    nodes = nodes.join(mended, ["kind", "mod"], "left").join(shortened, ["kind", "mod"], "left")
    nodes = nodes.withColumn("std", F.coalesce("mended", "stands_for", "mod")).drop("mended", "stands_for")
    nodes = nodes.join(nodes.groupBy("kind", "key", "std").agg(F.sum("n").alias("n_std")), ["kind", "key", "std"])
    nodes = durable(nodes.join(mods.select("kind", "mod", F.col("n").alias("n_all")), ["kind", "mod"], "left"), "p3-standard")

    def to(rows: DataFrame, channel: str, posterior: Column) -> DataFrame:
        return rows.select("kind", "key", "mod", "to_key", "to_mod", F.lit(channel).alias("channel"), posterior.cast("double").alias("posterior"))

    known = lambda name: F.log(F.lit(CHANNELS[name]))
    # the forms of a spelling that are no names of their own have no hypothesis to beat: 20 is more than any of them is written more often
    sure = F.lit(20.0)
    # 1. the same key and standard modifier
    same = _best(nodes, ["kind", "key", "std"], ["mod"])
    found = to(nodes.join(same, ["kind", "key", "std"]).withColumn("to_key", F.col("key")), "same", sure * 2)
    # 2. the same key, a modifier one typo away
    cuts = nodes.where(full("mod")).select("kind", "key", "mod", "n", "n_all", F.explode(deletions(F.col("mod"))).alias("cut"))
    rank = F.struct("n", "n_all", "mod")
    others = cuts.select("kind", "key", "cut", rank.alias("to_rank"), F.col("mod").alias("to_mod"))
    met = cuts.join(others, ["kind", "key", "cut"]).where((F.col("to_rank") > rank) & (F.length("mod") >= 4) & one_typo(F.col("mod"), F.col("to_mod")))
    own = F.log(1 + (F.col("n_all") - F.col("n")) / F.col("n"))  # other families with it
    dictionary = F.when(another_name(F.col("mod"), F.col("to_mod"), F.col("kind")), F.log(F.lit(LISTED_ODDS))).otherwise(0.0)
    found = found.unionByName(to(met.withColumn("to_key", F.col("key")), "modifier", F.log(F.col("to_rank.n") / F.col("n")) + known("modifier") + dictionary - own))
    # 3. the same key, a nickname and its full name, or two of one full name
    nick = F.broadcast(_nickname_rows(spark))  # a fixed table of some hundred short rows
    people = nodes.where((F.col("kind") == "person") & full("mod")).select("kind", "key", "mod", F.col("std").alias("_s"), "n")
    classes = people.join(nick.withColumnRenamed("mod", "_s"), "_s").select("kind", "key", "mod", "n", "full", F.lit(0).alias("is_full"))
    classes = classes.unionByName(people.select("kind", "key", "mod", "n", F.col("_s").alias("full"), F.lit(1).alias("is_full")))
    tops = classes.groupBy("kind", "key", "full").agg(F.max(F.struct("is_full", "n", "mod")).alias("t"), F.sum("n").alias("n_class"))
    nicknamed = classes.join(tops, ["kind", "key", "full"]).where(F.col("t.mod") != F.col("mod")).withColumns({"to_key": F.col("key"), "to_mod": F.col("t.mod")})
    found = found.unionByName(to(nicknamed, "nickname", sure + F.log("n_class") + F.when(F.col("t.is_full") == 1, known("nickname")).otherwise(known("nicknames"))))
    # 4. the same key, an initial and the most frequent modifier that begins with it; none at all and the most frequent one
    named = nodes.where(full("mod"))
    begins = named.groupBy("kind", "key", F.substring("std", 1, 1).alias("mod")).agg(F.max(F.struct("n", F.col("mod").alias("m"))).alias("t"))
    begun = nodes.where(F.length("mod") == 1).join(begins, ["kind", "key", "mod"]).withColumns({"to_key": F.col("key"), "to_mod": F.col("t.m")})
    found = found.unionByName(to(begun, "initial", sure + F.log("t.n") + known("initial")))
    only = named.groupBy("kind", "key").agg(F.max(F.struct("n", F.col("mod").alias("m"))).alias("t"))
    bare = nodes.where((F.length("mod") == 0) & (F.col("kind") == "organisation")).join(only, ["kind", "key"]).withColumns({"to_key": F.col("key"), "to_mod": F.col("t.m")})
    found = found.unionByName(to(bare, "bare", sure + F.log("t.n") + known("bare")))
    # 5. a key one typo away with the same standard modifier, full name or initial
    cols = ["kind", "key", "mod", "n_std", "n_key"]
    forms = nodes.where((F.length("mod") > 0) | (F.col("kind") == "organisation")).select(*cols, F.col("std").alias("form"), F.lit(0).alias("loose"))
    shorts = forms.where("kind = 'person'").join(nick.withColumnRenamed("mod", "form"), "form").select(*cols, F.col("full").alias("form"), F.lit(1).alias("loose"))
    initials = nodes.where((F.col("kind") == "person") & (F.length("mod") > 0)).select(*cols, F.concat(F.lit("="), F.substring("std", 1, 1)).alias("form"), F.lit(2).alias("loose"))
    forms = durable(forms.unionByName(shorts).unionByName(initials).withColumn("cut", F.explode(deletions(F.col("key"), 1))), "p3-forms")
    # of each key the best modifier, and the best that is an initial: the tests below ask nothing else of it
    block = forms.groupBy("kind", "cut", "form", F.col("key").alias("_k"), (F.length("mod") == 1).alias("_i")).agg(F.max(F.struct("n_std", "n_key", "key", "mod")).alias("t"))
    near_keys = forms.join(block, ["kind", "cut", "form"]).where((F.col("t.key") != F.col("key")) & one_typo(F.col("key"), F.col("t.key")))
    near_keys = near_keys.where((F.col("loose") < 2) | (F.length("mod") == 1) | (F.length("t.mod") == 1)).withColumns({"to_key": F.col("t.key"), "to_mod": F.col("t.mod")})
    own = F.log(1 + (F.col("n_key") - F.col("n_std")) / F.col("n_std"))  # a family of its own has other members
    short = F.least(F.length("key") - 5, F.lit(0)) * F.log(F.lit(SHORT_ODDS))
    posterior = F.log(F.col("t.n_std") / F.col("n_std")) + known("key") + short - own
    # the modifiers' agreement orders the candidates; whether the key is a typo at all, the counts of the keys say
    found = found.unionByName(to(near_keys.where(posterior >= 0), "key", posterior - F.col("loose") * F.log(F.lit(LOOSE)) + F.lit(2.0) * F.log(F.lit(LOOSE))))
    moved = (F.col("key") != F.col("to_key")) | (F.col("mod") != F.col("to_mod"))
    best = found.where(moved & (F.col("posterior") >= 0)).groupBy("kind", "key", "mod").agg(F.max(F.struct("posterior", "channel", "to_key", "to_mod")).alias("b"))
    parents = durable(best.select("kind", "key", "mod", "b.to_key", "b.to_mod", "b.channel", "b.posterior"), "p3-parents")
    return both.select("id", "kind", "key", "mod"), parents, durable(links.unionByName(merged).where(moved).distinct(), "p3-said")


def link_variants(registry: DataFrame, rounds: int = 30) -> DataFrame:
    """(id, kind, entity): rows that mean the same person or organisation carry the same ``entity``.

    Rows of other types, and rows that spell nothing, are left out. A spelling
    has one attachment at most; attachments, and what the registry itself calls
    one, are followed to a canonical form by spreading the least label along
    them, a round a join, until nothing changes; each round jumps over what the
    last one found, so a chain of length n takes log n rounds. Null columns count as not written; ties go to the later spelling
    in order; an empty registry gives no rows.
    """
    places, parents, said = attribute(registry)
    edges = parents.select("kind", "key", "mod", "to_key", "to_mod").unionByName(said)
    node = lambda k, m: F.concat_ws("\u0001", "kind", k, m)
    pairs = edges.select(node("key", "mod").alias("a"), node("to_key", "to_mod").alias("b"))
    pairs = durable(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "p3-pairs")
    labels = durable(pairs.select(F.col("a").alias("v"), F.col("a").alias("label")).distinct(), "p3-labels")
    for _ in range(rounds):
        heard = pairs.join(labels, pairs["b"] == labels["v"]).groupBy(F.col("a").alias("v")).agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, "v", "left").select("v", F.col("label").alias("old"), F.least("label", F.coalesce("heard", "label")).alias("label"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        new = durable(nearer.join(jump, "label", "left").select("v", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "p3-labels")
        changed = new.where(F.col("old") != F.col("label")).limit(1).count()
        labels = new.select("v", "label")
        if not changed:
            break
    else:
        raise RuntimeError(f"labels still change after {rounds} rounds")
    at = places.withColumn("v", node("key", "mod"))
    return at.join(labels, "v", "left").select("id", "kind", F.coalesce("label", "v").alias("entity"))


def same_pairs(linked: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of rows of one entity."""
    other = linked.select(F.col("id").alias("id_b"), "entity")
    return linked.select(F.col("id").alias("id_a"), "entity").join(other, "entity").where(F.col("id_a") < F.col("id_b")).select("id_a", "id_b").distinct()
