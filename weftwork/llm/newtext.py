"""The newly written text of e-mails.

Bodies are exploded into lines. A line is new unless it is a header line,
quoted, part of an original or forwarded message or of its introduction, or
belongs to the closing (formula, signature, device line, disclaimer). A closing
formula or a rule of dashes opens a closing that lasts until the next sentence;
only the signature mark "--" lasts to the end. A disclaimer shows two marks at
least: one word such as "confidential" makes none. What marks alone can't tell
is told by who wrote a line first: the messages of a thread are ranked by date
and a line counts for its first author only; and lines that a sender, or many
senders, use again and again at the end of messages are closing lines. All of
it is SQL windows over lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwork.operators.instants import normalise_instants
from weftwork.session import durable

FORMATS = ("eml", "msg", "mbox")

# Header fields, as mail programs write them in English, German, French, Spanish.
HEADER = r"(?i)^\s*\*?(from|to|cc|bcc|subject|date|sent|reply-to|importance|attachments|von|an|kopie|gesendet|betreff|datum|de|à|a|objet|envoyé|para|asunto|enviado|fecha)\s?:\*?(\s|$)"
#: Fields that name people hold an address; "To: do list" is no header.
PEOPLE = r"(?i)^\s*\*?(from|to|cc|bcc|von|an|de|à|a|para)\s?:"
HEADER_FROM = r"(?i)^\s*\*?(from|von|de)\s?:\*?\s"
WROTE = r"(wrote|schrieb|a écrit|escribió)"
ORIGINAL = r"(?i)^\s*(-{2,}\s*(original message|forwarded message|ursprüngliche nachricht|weitergeleitete nachricht|message d'origine|message original|message transféré|mensaje original|mensaje reenviado|forwarded by .*)\s*-{2,}|begin forwarded message:|anfang der weitergeleiteten nachricht:)\s*$"
RULE = r"^\s*_{10,}\s*$"
DELIMITER = r"^\s*(--|-{3,}|_{2,}|\*{3,}|={3,})\s*$"
QUOTE = r"^\s*>"

# Closing formulas, without case, accents' variants and punctuation at the end.
CLOSINGS = [
    "cheers", "thanks", "many thanks", "thanks again", "thank you", "regards", "kind regards", "best regards", "warm regards", "best", "best wishes", "all the best",
    "warmly", "yours sincerely", "yours faithfully", "yours truly", "yours", "sincerely", "take care", "talk soon", "see you", "cordially", "respectfully", "with thanks", "thx", "br", "kr",
    "mit freundlichen grüßen", "mit besten grüßen", "freundliche grüße", "viele grüße", "beste grüße", "liebe grüße", "herzliche grüße", "schöne grüße", "gruß", "grüße", "lg", "vg", "mfg", "danke",
    "cordialement", "bien cordialement", "amitiés", "bien à vous", "bien à toi", "sincèrement", "salutations", "meilleures salutations", "merci", "bises", "à bientôt",
    "atentamente", "saludos", "saludos cordiales", "un cordial saludo", "un saludo", "cordialmente", "un abrazo", "gracias", "muchas gracias", "abrazos",
]
DEVICE = r"(?i)^\s*(sent from my|sent from|get \S+ mail for|get outlook for|gesendet von|von meinem \S+ gesendet|envoyé de mon|envoyé depuis|enviado desde)\b"
#: The mark of a signature; what follows it in its part of the message is no new text.
SIGNATURE = r"^\s*--\s*$"
# What disclaimers speak of: secrecy, the message itself, its reader, its going astray, what is forbidden. Two of them make one.
LEGAL = [
    r"(?i)confidential|privileged|proprietary|vertraulich|confidentiel|confidencial|privado",
    r"(?i)\b(this|the) (e-?mail|message|mail|communication|transmission|contents?)\b|\bnotice:|diese[rs]? (e-?mail|nachricht|mail)|\bce (courriel|message|mail)\b|cet e-?mail|este (mensaje|correo)|esta comunicación",
    r"(?i)addressee|\brecipients?\b|intended (only |solely )?for|empfänger|adressat|destinat|destiné|lecteurs",
    r"(?i)by mistake|in error|\bdelete (it|this)|irrtümlich|löschen|par erreur|supprime[rz]|bórrel|elimine|por error|(notify|tell|inform) the sender",
    r"(?i)(not allowed|prohibited|forbidden|unauthori[sz]ed|untersagt|verboten|unzulässig|interdite?s?\b|prohibid)",
]
#: Sentences that are boilerplate by themselves: whose views these are, and pleas not to print.
BOILERPLATE = [
    r"(?i)\b(opinions?|views)\b.*\b(author|writer|sender|own)\b.*\b(bind|necessarily|represent|reflect|not those)\b",
    r"(?i)(environment|planet|forest|trees?|umwelt|environnement|medio ambiente)\b.*(print|druck|imprim)",
]
#: A sentence: ends like one, and has five words at least, and if there are figures in it three that begin small (an address has none); or a line so long that no signature has it.
ENDS, FIVE_WORDS, SMALL, PROSE_CHARS = r"[.!?…]['\")”»]*\s*$", r"^\s*\S+(?:\s+\S+){4}", r"(?:\s\p{Ll}\S*.*){3}", 120


#: Bits of a line's marks.
_BITS = ["quote", "header", "header_from", "rule", "original", "delimiter", "wrote_only", "wrote", "dated", "at_colon", "holds_at", "signs_off", "device", "disclaims", "signature", "prose"]


def _bit(name: str) -> Column:
    return F.col("marks").bitwiseAND(1 << _BITS.index(name)) != 0


def _messages(messages: DataFrame) -> DataFrame:
    """(id, text, sender, thread, at, twin) of e-mails with text, once an id (of rows that differ the greatest text holds), divided by id.

    sender is the address in author, else in the first From line, and thread
    the topic and the people of it; both as 64-bit hashes. twin is the hash of
    the text: a message sent twice is no second use of its lines.
    """
    mails = messages.where(F.get_json_object("metadata", "$.format").isin(*FORMATS) & F.col("text").isNotNull())
    mails = mails.select("id", "text", "author", "date", "subject", "recipients", F.get_json_object("metadata", "$.tz").alias("tz"), F.get_json_object("metadata", "$.locale").alias("locale"))
    mails = normalise_instants(mails, "date", "tz", "locale", "at")
    address = r"[\w.+\-]+@[\w.\-]+\w"
    in_text = lambda c: F.nullif(F.regexp_extract(c, address, 0), F.lit(""))
    from_line = F.regexp_extract("text", r"(?im)\A\s*from:(.*)$", 1)
    sender = F.lower(F.coalesce(in_text("author"), in_text(from_line), F.nullif(F.trim("author"), F.lit("")), F.lit("?")))
    topic = F.lower(F.trim(F.regexp_replace(F.coalesce("subject", F.lit("")), r"(?i)^(\s*(re|aw|fwd|fw|wg|tr|rv|sv)\s*:)+", "")))
    others = F.transform(F.coalesce("recipients", F.array().cast("array<string>")), lambda r: F.lower(F.coalesce(F.nullif(F.regexp_extract(r, address, 0), F.lit("")), r, F.lit("?"))))
    people = F.array_join(F.array_sort(F.array_distinct(F.concat(F.array(sender), others))), ",")
    made = mails.select("id", "text", F.xxhash64(sender).alias("sender"), F.xxhash64(topic, people).alias("thread"), "at", F.xxhash64("text").alias("twin"))
    return made.groupBy("id").agg(F.max(F.struct("text", "sender", "thread", "at", "twin")).alias("m")).select("id", "m.*")


def message_lines(messages: DataFrame) -> DataFrame:
    """(id, line_no, line, sender, thread, at, twin) of every non-blank line; lines are split at \\n and counted from 0, blank ones included in the count."""
    lines = _messages(messages).select("id", "sender", "thread", "at", "twin", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.withColumn("line_no", F.col("line_no").cast("long")).where(F.col("line").rlike(r"[^\s ​]"))


def _marked(lines: DataFrame) -> DataFrame:
    """Lines as (id, line_no, sender, thread, at, twin, norm, size, marks): what later steps need, without the text.

    norm is the 64-bit hash of the line without quote marks, case and repeated
    blanks, size its length. Of a quoted line nothing but that is marked.
    """
    line = F.col("line")
    rows = lines.withColumn("_norm", F.lower(F.trim(F.regexp_replace(F.regexp_replace("line", "^[>\\s]+", ""), r"[\s ]+", " "))))
    bare = F.regexp_replace("_norm", r"[\s,.;:!\-–—]+$", "")
    holds_at, wrote_word, short = line.contains("@"), line.rlike(WROTE), F.length(line) <= 60
    marks_of = [F.when(line.rlike(p), 1).otherwise(0) for p in LEGAL]
    disclaims = (F.length(line) > 25) & ((sum(marks_of[1:], marks_of[0]) >= 2) | line.rlike(BOILERPLATE[0]) | line.rlike(BOILERPLATE[1]))
    tests = {
        "header": line.contains(":") & line.rlike(HEADER) & (~line.rlike(PEOPLE) | holds_at), "header_from": line.contains(":") & line.rlike(HEADER_FROM), "rule": line.startswith("_") & line.rlike(RULE),
        "original": line.rlike(ORIGINAL), "delimiter": short & line.rlike(DELIMITER),
        "wrote_only": wrote_word & (line.rlike(rf"(?i)^\s*{WROTE}\s*:?\s*$") | line.rlike(rf"(?i)^[^>]*@\S+>?\s+{WROTE}\s*:\s*$")),
        "wrote": wrote_word & (line.rlike(rf"(?i)(@.*|^\s*(on|am|le|el)\b.*\d.*){WROTE}\s*:?\s*$") | line.rlike(rf"(?i)^\s*(am|on|le|el)\b.*\d.*{WROTE}\b.*:\s*$")),
        "dated": line.rlike(r"(?i)^\s*(on|am|le|el)\s.*\d") & line.rlike(r"@|,\s*$"), "at_colon": holds_at & line.rlike(r"@\S+\s*:\s*$"), "holds_at": holds_at,
        "signs_off": short & bare.isin(CLOSINGS), "device": line.rlike(DEVICE), "disclaims": disclaims, "signature": short & line.rlike(SIGNATURE),
        "prose": (F.length(line) > PROSE_CHARS) | (line.rlike(FIVE_WORDS) & line.rlike(ENDS) & (~line.rlike(r"\d") | line.rlike(SMALL))),
    }
    total = F.lit(0)
    for name, test in tests.items():
        total = total + F.when(test, 1 << _BITS.index(name)).otherwise(0)
    marks = F.when(line.rlike(QUOTE), 1).otherwise(total).cast("int")
    return rows.select("id", "line_no", "sender", "thread", "at", "twin", F.xxhash64("_norm").alias("norm"), F.length("_norm").alias("size"), marks.alias("marks"))


def classified(messages: DataFrame, first_author_chars: int = 40, sender_recurs: int = 3, sender_share: float = 0.1, senders_recur: int = 5, at_end: float = 0.95) -> DataFrame:
    """(id, line_no, kind) of every non-blank line; kind is new, header, quote, intro, original, closing, disclaimer or not_first.

    ``first_author_chars``: shorter lines are not evidence of copying. A line
    after the body's first recurs if it stands in ``sender_recurs`` messages of
    one sender and in ``sender_share`` of them, or with ``senders_recur``
    senders who use it twice on average; if, besides, ``at_end`` of its places
    are not followed by text that nobody repeats, it is a closing line. Equal
    messages count once, so a table repeated under new ids gives the same
    kinds. Null author, subject, recipients or date: what they would tell is
    not used.

    Messages are moved once, by id; their lines stay where they are for the
    windows, and only marks and hashes of lines are kept and moved after that;
    lines that their marks decide are not moved again.
    """
    x = _marked(message_lines(messages))
    order = Window.partitionBy("id").orderBy("line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    any_so_far = lambda c: F.coalesce(F.max(c.cast("int")).over(so_far), F.lit(0)) == 1
    after = lambda name: F.coalesce(F.lead(F.col("marks")).over(order).bitwiseAND(1 << _BITS.index(name)) != 0, F.lit(False))
    prior = lambda name: F.coalesce(F.lag(F.col("marks")).over(order).bitwiseAND(1 << _BITS.index(name)) != 0, F.lit(False))
    plain = ~_bit("quote")
    x = x.withColumns(
        {
            "head": _bit("header") & (F.sum((~_bit("header")).cast("int")).over(so_far) == 0),
            "intro": plain & (_bit("wrote") | (_bit("at_colon") & after("quote")) | (_bit("dated") & after("wrote_only")) | (_bit("wrote_only") & (prior("dated") | prior("holds_at")))),
            "starts": plain & (_bit("original") | (_bit("rule") & after("header")) | (_bit("header_from") & after("header"))),
            "quoted_next": after("quote"),
        }
    )
    # an introduction that no marked line follows opens a quotation without marks
    x = x.withColumns({"in_original": any_so_far(F.col("starts") & ~F.col("head")), "in_unmarked": any_so_far(F.col("intro") & ~F.col("quoted_next") & ~F.coalesce(F.lead("intro").over(order), F.lit(False)))})
    part = (
        F.when(F.col("head"), "header").when(F.col("in_original"), "original").when(_bit("quote"), "quote").when(F.col("intro"), "intro").when(F.col("in_unmarked"), "quote").otherwise("content")
    )
    x = x.withColumn("part", part).withColumn("content", F.col("part") == "content")
    # a closing lasts until the next sentence, or the end of its part of the message
    prose = F.col("content") & _bit("prose") & ~_bit("disclaims")
    running = lambda c: F.sum(c.cast("int")).over(so_far)
    x = x.withColumns({"nth": running(F.col("content")), "part_no": running(~F.col("content")), "_prose": prose})
    x = x.withColumns({"told_no": running(F.col("_prose")) + F.col("part_no"), "next_prose": F.coalesce(F.lead("_prose").over(order), F.lit(False))})
    opens = F.col("content") & (_bit("delimiter") | (_bit("signs_off") & ((F.col("nth") > 1) | ~F.col("next_prose"))))
    lasting = F.max(F.when(opens, F.col("told_no"))).over(so_far) == F.col("told_no")
    signed = F.max(F.when(F.col("content") & _bit("signature"), F.col("part_no"))).over(before) == F.col("part_no")
    x = x.withColumn("closing", F.col("content") & (F.coalesce(lasting & ~F.col("_prose"), F.lit(False)) | F.coalesce(signed, F.lit(False))))
    decided = (
        F.when(F.col("part") != "content", F.col("part")).when(_bit("disclaims"), "disclaimer").when(F.col("closing") | _bit("device"), "closing")
    )
    x = durable(x.select("id", "line_no", "sender", "thread", "at", "twin", "norm", "size", "nth", decided.alias("decided"), F.col("content")), "p5-marked")

    # recurrence, counted over all messages; only content lines after the first one of their message count as closing lines
    content = x.where("content")
    later = content.where("nth > 1").select("id", "line_no", "norm", "size", "sender", "twin")
    recurs = later.groupBy("norm", "sender").agg(F.count_distinct("twin").alias("in_messages"))
    known = recurs.groupBy("norm").agg(F.count("*").alias("senders"), F.sum("in_messages").alias("messages"))
    often_said = known.where((F.col("senders") >= senders_recur) & (F.col("messages") >= 2 * F.col("senders")))
    sent = content.groupBy("sender").agg(F.count_distinct("twin").alias("sent"))
    of_one = recurs.where(F.col("in_messages") >= sender_recurs).join(sent, "sender").where(F.col("in_messages") >= sender_share * F.col("sent")).select("norm", "sender")
    # a closing line is hardly ever followed by text that nobody repeats
    told_once = later.where(F.col("size") >= first_author_chars).join(often_said, "norm", "left_anti").groupBy("id").agg(F.max("line_no").alias("last_told"))
    many = often_said.select("norm").unionByName(of_one.select("norm")).distinct()
    last = F.avg((F.col("line_no") > F.coalesce("last_told", F.lit(-1))).cast("int"))
    ends = later.join(many, "norm").join(told_once, "id", "left").groupBy("norm").agg(last.alias("_at_end")).where(F.col("_at_end") >= at_end).select("norm")
    often = of_one.join(ends, "norm", "left_semi").withColumn("of_sender", F.lit(True))
    common = often_said.join(ends, "norm", "left_semi").select("norm", F.lit(True).alias("of_many"))

    # the first author of a line of a thread, by date; only lines that two senders have matter
    told = content.where((F.col("size") >= first_author_chars) & F.col("at").isNotNull()).groupBy("thread", "norm").agg(F.min(F.struct("at", "sender")).alias("first"), F.min("sender").alias("lo"), F.max("sender").alias("hi"))
    first = told.where("lo <> hi").select("thread", "norm", "first")

    y = x.where("decided is null").select("id", "line_no", "sender", "thread", "at", "norm", "size", "nth")
    y = y.join(often, ["norm", "sender"], "left").join(common, "norm", "left").join(first, ["thread", "norm"], "left")
    copied = F.coalesce((F.col("first.at") < F.col("at")) & (F.col("first.sender") != F.col("sender")), F.lit(False)) & (F.col("size") >= first_author_chars)
    recurrent = (F.col("nth") > 1) & (F.coalesce("of_sender", F.lit(False)) | F.coalesce("of_many", F.lit(False)))
    open_lines = y.select("id", "line_no", F.when(recurrent, "closing").when(copied, "not_first").otherwise("new").alias("kind"))
    return open_lines.unionByName(x.where("decided is not null").select("id", "line_no", F.col("decided").alias("kind")))


def new_text(messages: DataFrame) -> DataFrame:
    """(id, text): each e-mail reduced to its new lines, joined again in order; e-mails without any have the empty text."""
    lines = message_lines(messages).select("id", "line_no", "line")
    rows = classified(messages).join(lines, ["id", "line_no"])
    kept = F.filter(F.array_sort(F.collect_list(F.struct("line_no", F.when(F.col("kind") == "new", F.col("line")).alias("line")))), lambda r: r["line"].isNotNull())
    return rows.groupBy("id").agg(F.array_join(F.transform(kept, lambda r: r["line"]), "\n").alias("text"))
