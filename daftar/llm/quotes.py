"""Chat formatting: quotations are linked to the messages they quote, then taken out.

A message's lines have a quote level, the number of ``>`` before them. Consecutive lines of one
level are a passage; blank lines and attributions end one. Passages are normalised and hashed.
Quoted ones join the hashes of what messages say themselves: first the earliest earlier turn of the
same conversation, else the earliest message of another one. A message replies to what its
shallowest linked passage quotes, else to the turn before; threads follow from that.

Everything is DataFrame operations. Originals are one row per conversation and hash before the join,
so a greeting that opens a third of all conversations is a partial minimum per task, and no quotation
meets more than one original. Threads are found by pointer doubling on (conversation, turn).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.llm.common import LOWER, UPPER, Scratch, ascii_lower

_MARK = r"^[> \t]*"
_ATTRIBUTION = r"^(On|Le|Am|El) .*(wrote|écrit|schrieb|escribió) ?:$"
_STARTS, _LEVEL = "\x01", "\x02"


def _shifted(items: Column, by: int) -> Column:
    """The array with its elements moved one place to the right (1) or left (-1), a null coming in."""
    none = F.array(F.lit(None))
    if by > 0:
        return F.concat(none, F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))))
    return F.concat(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), none)


def _level(line: Column) -> Column:
    return F.length(F.translate(F.regexp_extract(line, _MARK, 0), " \t", ""))


def _body(line: Column) -> Column:
    bare = F.regexp_replace(F.translate(line, _STARTS + _LEVEL, ""), _MARK, "")
    return F.trim(F.regexp_replace(bare, r"[ \t]+", " "))


def _parsed(text: Column) -> Column:
    """Per line: level, body and raw; an attribution of the quotation that follows has no body and no raw."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")

    def line(own: Column, after: Column) -> Column:
        names = F.regexp_like(_body(own), F.lit(_ATTRIBUTION)) & (_level(own) < F.coalesce(_level(after), F.lit(0)))
        return F.struct(
            _level(own).alias("level"), F.when(names, "").otherwise(_body(own)).alias("body"), F.when(~names, own).alias("raw")
        )

    return F.zip_with(lines, _shifted(lines, -1).cast("array<string>"), line)


def _passages(lines: Column) -> Column:
    """``level \\x02 words`` of each run of lines of one level, empty runs left out."""

    def piece(own: Column, before: Column) -> Column:
        goes_on = (own.level == before.level) & (own.body != "") & (before.body != "")
        start = F.concat(F.lit(_STARTS), own.level.cast("string"), F.lit(_LEVEL))
        return F.concat(F.when(goes_on, " ").otherwise(start), own.body)

    joined = F.array_join(F.zip_with(lines, _shifted(lines, 1), piece), "")
    return F.filter(F.split(joined, _STARTS), lambda p: ~F.endswith(p, F.lit(_LEVEL)) & (p != ""))


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body (the text without quotations) and passages (array of level, digest)."""
    lines = _parsed(F.col("text"))
    own = F.array_join(F.transform(F.filter(lines, lambda x: (x.level == 0) & x.raw.isNotNull()), lambda x: x.raw), "\n")
    tidy = F.regexp_replace(F.regexp_replace(own, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")
    digests = F.transform(
        _passages(lines),
        lambda p: F.struct(
            F.substring_index(p, _LEVEL, 1).cast("int").alias("level"),
            F.md5(ascii_lower(F.substring_index(p, _LEVEL, -1)).cast("binary")).alias("digest"),
        ),
    )
    return messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role",
        F.when(F.col("text").isNotNull(), tidy).alias("body"), digests.alias("passages"),
    )


def _threads(replies: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, turn, thread, depth) from distinct (conv_id, turn, parent): the first turn of its chain, and steps to it.

    Parents are earlier turns, so chains end. Each round doubles how far every turn sees; turns that
    see the first of their chain take no part in later rounds, so one long conversation costs the
    others nothing.
    """
    current = replies.select(
        "conv_id", "turn", F.coalesce("parent", "turn").alias("thread"),
        F.col("parent").isNotNull().cast("long").alias("depth"), F.col("parent").isNull().alias("done"),
    )
    current = scratch.put(current, "thread-0")
    step = 0
    while not current.where(~F.col("done")).isEmpty():
        ahead = current.select(
            "conv_id", F.col("turn").alias("thread"), F.col("thread").alias("_thread"), F.col("depth").alias("_depth"), F.col("done").alias("_done")
        )
        moved = current.where(~F.col("done")).join(ahead, ["conv_id", "thread"]).select(
            "conv_id", "turn", F.col("_thread").alias("thread"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done")
        )
        step += 1
        after = scratch.put(current.where("done").unionByName(moved), f"thread-{step}")
        scratch.drop(f"thread-{step - 1}")
        current = after
    return current.drop("done")


def link(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, body, n_quotes, n_linked, reply_conv, reply_turn, thread and depth of every message.

    ``reply_conv`` and ``reply_turn`` name the message replied to, null for a first message. Sorted
    by conv_id, thread and turn, messages stand in reply order, each behind the one it answers;
    ``thread`` is the first turn of its chain of replies within the conversation and ``depth`` the
    number of replies since. A message whose turn has no predecessor and no link starts a thread.

    A null text has a null body and no quotations. Rows without conversation or turn keep their row,
    are linked to nothing and start a thread of their own (a null thread if the turn is null). Rows
    that repeat a turn get what all rows of that turn link to. Ties between originals go to the
    earliest. An empty table gives an empty result; further columns are not read.
    """
    scratch = Scratch(messages.sparkSession, "quotes")
    rows = scratch.put(parse(messages), "parsed")
    said = rows.select("conv_id", "turn", F.explode("passages").alias("p")).where("conv_id IS NOT NULL AND turn IS NOT NULL")
    said = said.select("conv_id", "turn", F.col("p.level").alias("level"), F.col("p.digest").alias("digest"))
    quoted = scratch.put(said.where("level > 0"), "quoted")
    wanted = quoted.select("digest").distinct()
    own = said.where("level = 0").join(wanted, "digest", "left_semi").groupBy("digest", "conv_id").agg(F.min("turn").alias("own_turn"))
    own = scratch.put(own, "originals")
    anywhere = own.groupBy("digest").agg(F.min(F.struct("conv_id", "own_turn")).alias("o"))
    anywhere = anywhere.select("digest", F.col("o.conv_id").alias("far_conv"), F.col("o.own_turn").alias("far_turn"))
    met = quoted.join(own, ["digest", "conv_id"], "left").join(anywhere, "digest", "left")
    near = F.col("own_turn") < F.col("turn")
    far = F.col("far_conv") != F.col("conv_id")
    linked = met.select(
        "conv_id", "turn", "level",
        F.when(near, F.col("conv_id")).when(far, F.col("far_conv")).alias("to_conv"),
        F.when(near, F.col("own_turn")).when(far, F.col("far_turn")).alias("to_turn"),
    )
    # The shallowest linked passage, a link into the same conversation before others, the latest turn of those.
    found = F.col("to_conv").isNotNull()
    rank = F.struct(F.col("level"), (F.col("to_conv") != F.col("conv_id")).cast("int"), -F.col("to_turn"), F.col("to_conv"))
    summed = linked.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_quotes"), F.count_if(found).alias("n_linked"),
        F.min_by(F.when(found, F.struct("to_conv", "to_turn")), F.when(found, rank)).alias("to"),
    )
    turns = rows.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.lit(True).alias("has_before"))
    replies = turns.join(summed, ["conv_id", "turn"], "left").join(before, ["conv_id", "turn"], "left")
    previous = F.when(F.col("has_before"), F.col("turn") - 1)
    replies = replies.select(
        "conv_id", "turn", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.coalesce("to.to_conv", F.when(previous.isNotNull(), F.col("conv_id"))).alias("reply_conv"),
        F.coalesce("to.to_turn", previous).alias("reply_turn"),
    )
    replies = scratch.put(replies, "replies")
    parent = F.when(F.col("reply_conv") == F.col("conv_id"), F.col("reply_turn"))
    threads = _threads(replies.select("conv_id", "turn", parent.alias("parent")), scratch)
    keyed = replies.join(threads, ["conv_id", "turn"])
    out = rows.drop("passages").join(keyed, ["conv_id", "turn"], "left")
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return out.select(
        "conv_id", "turn", "role", "body", zero("n_quotes"), zero("n_linked"), "reply_conv", "reply_turn",
        F.coalesce("thread", "turn").alias("thread"), zero("depth"),
    )


SQL = f"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, text FROM conversations),
  l0 AS (SELECT id, unnest(string_split_regex(coalesce(text, ''), '\\r\\n|\\r|\\n')) AS raw,
                generate_subscripts(string_split_regex(coalesce(text, ''), '\\r\\n|\\r|\\n'), 1) AS n FROM m),
  l1 AS (SELECT id, n, raw, len(replace(replace(regexp_extract(raw, '^[> \\t]*'), ' ', ''), chr(9), '')) AS level,
                trim(regexp_replace(regexp_replace(raw, '^[> \\t]*', ''), '[ \\t]+', ' ', 'g'), ' ') AS body FROM l0),
  l2 AS (SELECT *, regexp_matches(body, '{_ATTRIBUTION}') AND level < coalesce(lead(level) OVER (PARTITION BY id ORDER BY n), 0) AS names FROM l1),
  l3 AS (SELECT id, n, level, CASE WHEN names THEN '' ELSE body END AS body, CASE WHEN NOT names THEN raw END AS raw FROM l2),
  l4 AS (SELECT *, NOT coalesce(level = lag(level) OVER w AND body <> '' AND lag(body) OVER w <> '', false) AS starts FROM l3 WINDOW w AS (PARTITION BY id ORDER BY n)),
  l5 AS (SELECT *, sum(starts::INT) OVER (PARTITION BY id ORDER BY n) AS part FROM l4),
  said AS (SELECT conv_id, turn, level, md5(translate(words, '{UPPER}', '{LOWER}')) AS digest FROM (
      SELECT id, part, any_value(level) AS level, string_agg(body, ' ' ORDER BY n) AS words FROM l5 GROUP BY id, part) p JOIN m USING (id)
    WHERE words <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL),
  bodies AS (SELECT id, regexp_replace(regexp_replace(coalesce(string_agg(raw, chr(10) ORDER BY n) FILTER (level = 0 AND raw IS NOT NULL), ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS body FROM l5 GROUP BY id),
  own AS (SELECT digest, conv_id, min(turn) AS own_turn FROM said WHERE level = 0 GROUP BY ALL),
  far AS (SELECT digest, min((conv_id, own_turn)) AS o FROM own GROUP BY digest),
  linked AS (SELECT q.conv_id, q.turn, level,
      CASE WHEN own_turn < turn THEN q.conv_id WHEN o[1] <> q.conv_id THEN o[1] END AS to_conv,
      CASE WHEN own_turn < turn THEN own_turn WHEN o[1] <> q.conv_id THEN o[2] END AS to_turn
    FROM said q LEFT JOIN own USING (digest, conv_id) LEFT JOIN far USING (digest) WHERE level > 0),
  summed AS (SELECT conv_id, turn, count(*) AS n_quotes, count(to_conv) AS n_linked,
      arg_min((to_conv, to_turn), (level, (to_conv <> conv_id)::INT, -to_turn, to_conv)) FILTER (to_conv IS NOT NULL) AS dest FROM linked GROUP BY ALL),
  turns AS (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
  replies AS (SELECT t.conv_id, t.turn, coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked,
      coalesce(dest[1], b.conv_id) AS reply_conv, coalesce(dest[2], b.turn) AS reply_turn
    FROM turns t LEFT JOIN summed USING (conv_id, turn) LEFT JOIN turns b ON b.conv_id = t.conv_id AND b.turn = t.turn - 1),
  walk AS (SELECT conv_id, turn, turn AS spot, 0 AS depth FROM replies
    UNION ALL SELECT w.conv_id, w.turn, r.reply_turn, depth + 1 FROM walk w JOIN replies r ON r.conv_id = w.conv_id AND r.turn = w.spot WHERE r.reply_conv = r.conv_id),
  threads AS (SELECT conv_id, turn, arg_max(spot, depth) AS thread, max(depth) AS depth FROM walk GROUP BY ALL)
SELECT m.conv_id, m.turn, role, CASE WHEN text IS NOT NULL THEN body END AS body, coalesce(n_quotes, 0)::BIGINT AS n_quotes,
  coalesce(n_linked, 0)::BIGINT AS n_linked, reply_conv, reply_turn, coalesce(thread, m.turn) AS thread, coalesce(depth, 0)::BIGINT AS depth
FROM m JOIN bodies USING (id) LEFT JOIN replies r ON r.conv_id = m.conv_id AND r.turn = m.turn
LEFT JOIN threads t ON t.conv_id = m.conv_id AND t.turn = m.turn
"""
