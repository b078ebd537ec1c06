"""Chat formatting by quotation linking, in DataFrame operations only.

Quote levels are parsed line by line. A quoted passage, a run of lines of one level, is
normalised and hashed, and joined to the first message of the conversation that has this
passage as its own text: the whole of it, what it says between two quotes, a paragraph, or any
lines that follow each other, blank ones aside. Links give each message its parent; following
them to the end gives its thread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MARKS = r"^((?:[ \t]*>)+)"
BREAK = r"\r?\n"
QUOTED = r"(?m)^[ \t]*>"
QUOTED_LINE = r"(?m)^[ \t]*>[^\n]*(?:\n|\z)"


def level_of(line: Column) -> Column:
    """The number of quote marks that a line begins with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def content_of(line: Column) -> Column:
    """A line without its quote marks."""
    return F.regexp_replace(line, MARKS + r"[ \t]?", "")


def normalised(text: Column) -> Column:
    """Lower case, with runs of white space as one space and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def own_text(text: Column) -> Column:
    """The lines that aren't quoted, without blank lines at the ends; null for null."""
    lines = F.filter(F.split(text, BREAK, -1), lambda x: ~x.rlike(MARKS))
    return F.when(text.rlike(QUOTED), F.regexp_replace(F.array_join(lines, "\n"), r"\A\s+|\s+\z", "")).otherwise(text)


def lines_of(text: Column) -> Column:
    """The normalised lines that aren't blank."""
    return F.filter(F.transform(F.split(text, BREAK, -1), normalised), lambda x: x != "")


def _key(frame: DataFrame) -> Column:
    return F.xxhash64(*[frame[c] for c in ("conv", "turn", "role", "text")])


def quoted_passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, mid, level, hash, first, size) of every quoted passage that isn't blank, with its first line and the number of its lines. messages: conv, turn, role, text, mid."""
    lines = messages.where(F.col("text").rlike(QUOTED)).dropDuplicates(["conv", "mid"]).select("conv", "turn", "mid", F.posexplode(F.split("text", BREAK, -1)).alias("pos", "line"))
    marked = lines.select("conv", "turn", "mid", "pos", level_of(F.col("line")).alias("level"), content_of(F.col("line")).alias("line"))
    at = Window.partitionBy("conv", "mid").orderBy("pos")  # one message's lines
    runs = marked.withColumn("new", F.when(F.lag("level").over(at).eqNullSafe(F.col("level")), 0).otherwise(1)).withColumn("run", F.sum("new").over(at))
    whole = runs.where("level > 0").groupBy("conv", "turn", "mid", "run", "level").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("passage"))
    said = whole.select("conv", "turn", "mid", "level", lines_of(F.col("passage")).alias("lines")).where(F.size("lines") > 0)
    return said.select("conv", "turn", "mid", "level", F.sha2(F.array_join("lines", " "), 256).alias("hash"), F.get("lines", 0).alias("first"), F.size("lines").alias("size"))


def originals(messages: DataFrame, passages: DataFrame) -> DataFrame:
    """(conv, hash, turn): the first message of each passage that a message has as its own text, in conversations with quotes.

    Lines that follow each other are hashed only where they begin with the first line of a
    passage of the conversation and are as many as it has, so that hashes grow with the matches.
    """
    within = messages.join(passages.select(F.col("conv").alias("c")).distinct(), F.col("conv") == F.col("c"), "left_semi").where("turn is not null").select("conv", "turn", "mid", "text").dropDuplicates(["conv", "mid"])
    own = cut(within.select("conv", "turn", "mid", own_text(F.col("text")).alias("own"), F.split("text", QUOTED_LINE, -1).alias("runs")))
    units = F.array_distinct(F.concat(F.array("own"), F.split("own", r"\r?\n[ \t]*\r?\n", -1), "runs"))
    each = own.select("conv", "turn", F.explode(units).alias("unit")).select("conv", "turn", normalised(F.col("unit")).alias("n")).where("n <> ''")
    begun = passages.groupBy(F.col("conv").alias("c"), "first").agg(F.collect_set("size").alias("sizes"))  # lengths of quotes
    lines = own.select("conv", "turn", "mid", lines_of(F.col("own")).alias("lines"))
    at = lines.select("conv", "mid", F.posexplode("lines").alias("pos", "line")).join(begun, (F.col("conv") == F.col("c")) & (F.col("line") == F.col("first"))).select("conv", "mid", "pos", F.explode("sizes").alias("size"))
    at = at.groupBy(F.col("conv").alias("c"), F.col("mid").alias("m")).agg(F.collect_list(F.struct("pos", "size")).alias("at"))  # of one message
    spans = lines.join(at, (F.col("conv") == F.col("c")) & (F.col("mid") == F.col("m"))).select("conv", "turn", "lines", F.explode("at").alias("at")).where(F.col("at.pos") + F.col("at.size") <= F.size("lines"))
    spans = spans.select("conv", "turn", F.array_join(F.slice("lines", F.col("at.pos") + 1, F.col("at.size")), " ").alias("n"))
    return each.unionByName(spans).groupBy("conv", F.sha2("n", 256).alias("hash")).agg(F.min("turn").alias("turn"))


def threads(links: DataFrame) -> DataFrame:
    """(conv, turn, thread, depth) of every turn with a parent, by pointer doubling. links: (conv, turn, parent), parent < turn, one row per turn.

    Rounds grow with the logarithm of the deepest thread.
    """
    now = cut(links.select("conv", "turn", F.col("parent").alias("thread"), F.lit(1).cast("long").alias("depth")))
    while True:
        up = now.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("thread").alias("above"), F.col("depth").alias("more"))
        step = now.join(up, (F.col("conv") == F.col("c")) & (F.col("thread") == F.col("t")), "left")
        step = cut(step.select("conv", "turn", F.coalesce("above", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("above").isNotNull().alias("moved")))
        now = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return now


def link_quotes(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, text (without quoted lines), parent_turn, thread_turn, depth, n_quotes, n_linked, quote_level.

    Reply order is (conv_id, thread_turn, turn): threads by their first message, in which every
    message follows the one it answers; reply_ordered() numbers it. A passage's original is the first message of the same
    conversation that has it, if that is an earlier turn. A message's parent is the original of
    its least deeply quoted passage, of several the latest. A message without a linked quote
    begins a thread of its own. Where messages share a turn, what answers that turn follows the
    turn's smallest parent. Repeated messages each get the same row. Messages with a null
    conversation or turn are kept and linked to nothing; a null text stays null. Other columns
    are left out, whatever their names. Messages without quotes pass in a map.
    """
    plain = conversations.select(conversations[conv_col].alias("conv"), conversations[turn_col].cast("long").alias("turn"), conversations[role_col].alias("role"), conversations[text_col].cast("string").alias("text"))
    messages = plain.withColumn("mid", _key(plain))
    names = [F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col)]
    none = F.lit(None).cast("long")
    quotes = F.coalesce(F.col("text").rlike(QUOTED), F.lit(False))
    unquoted = messages.where(~quotes).select(*names, F.col("text").alias(text_col), none.alias("parent_turn"), F.col("turn").alias("thread_turn"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("n_quotes"), F.lit(0).cast("long").alias("n_linked"), F.lit(0).alias("quote_level"))
    passages = cut(quoted_passages(messages))
    first = originals(messages, passages).select(F.col("conv").alias("c"), F.col("hash").alias("h"), F.col("turn").alias("found"))
    joined = passages.join(first, (F.col("conv") == F.col("c")) & (F.col("hash") == F.col("h")) & (F.col("found") < F.col("turn")), "left")
    best = F.min(F.when(F.col("found").isNotNull(), F.struct("level", (-F.col("found")).alias("o"))))
    per = joined.groupBy("conv", "turn", "mid").agg((-best["o"]).alias("parent"), F.count(F.lit(1)).alias("n_quotes"), F.count("found").alias("n_linked"), F.max("level").alias("quote_level"))
    per = cut(per)
    links = per.where("parent is not null").groupBy("conv", "turn").agg(F.min("parent").alias("parent"))
    roots = threads(links).select(F.col("conv").alias("rc"), F.col("turn").alias("rt"), "thread", "depth")
    per = per.join(roots, (F.col("conv") == F.col("rc")) & (F.col("parent") == F.col("rt")), "left").select(F.col("conv").alias("pc"), F.col("mid").alias("pm"), "parent", "n_quotes", "n_linked", "quote_level", F.when(F.col("parent").isNotNull(), F.coalesce("thread", "parent")).alias("thread"), F.when(F.col("parent").isNotNull(), 1 + F.coalesce("depth", F.lit(0))).alias("depth"))
    quoting = messages.where(quotes).join(per, F.col("conv").eqNullSafe(F.col("pc")) & (F.col("mid") == F.col("pm")), "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    quoting = quoting.select(*names, own_text(F.col("text")).alias(text_col), F.col("parent").cast("long").alias("parent_turn"), F.coalesce("thread", "turn").cast("long").alias("thread_turn"), count("depth"), count("n_quotes"), count("n_linked"), F.coalesce("quote_level", F.lit(0)).alias("quote_level"))
    return unquoted.unionByName(quoting)


def reply_ordered(linked: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """link_quotes() with `position`: the place of each message in its conversation's reply order, from 1.

    Messages that share a turn and a thread share a place; those without a conversation or turn
    have none. Places are counted in ranges of the order and the ranges of a conversation added
    up, so that a very long conversation isn't one task's; texts move once, in a join.
    """
    keys = linked.where(F.col(conv_col).isNotNull() & F.col(turn_col).isNotNull()).select(F.col(conv_col).alias("kc"), F.col("thread_turn").alias("kh"), F.col(turn_col).alias("kt")).distinct()
    parts = cut(keys.repartitionByRange("kc", "kh", "kt").withColumn("part", F.spark_partition_id()))
    sizes = parts.groupBy("kc", "part").count()
    before = Window.partitionBy("kc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range of a conversation
    sizes = sizes.select(F.col("kc").alias("sc"), F.col("part").alias("sp"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("kc", "part").orderBy("kh", "kt"))
    placed = parts.withColumn("own", own).join(sizes, (F.col("kc") == F.col("sc")) & (F.col("part") == F.col("sp"))).select("kc", "kh", "kt", (F.col("before") + F.col("own")).alias("position"))
    return linked.join(placed, (F.col(conv_col) == F.col("kc")) & (F.col("thread_turn") == F.col("kh")) & (F.col(turn_col) == F.col("kt")), "left").select(*linked.columns, "position")


def brute(messages: list[tuple]) -> list[tuple]:
    """link_quotes() of (conv, turn, role, text) rows, one message at a time (for tests)."""
    import re

    squeeze = lambda s: re.sub(r"[ \t\n\x0b\f\r]+", " ", s.lower()).strip(" ")
    mark = re.compile(r"((?:[ \t]*>)+)[ \t]?")

    def parse(text: str | None) -> tuple[str | None, list[tuple[int, str]]]:
        if text is None or not re.search(r"(?m)^[ \t]*>", text):
            return text, []
        own, runs = [], []
        last = None
        for line in re.split(BREAK, text):
            m = mark.match(line)
            level = m[1].count(">") if m else 0
            if not level:
                own.append(line)
            elif level == last:
                runs[-1][1].append(line[m.end() :])
            else:
                runs.append((level, [line[m.end() :]]))
            last = level
        return re.sub(r"\A[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+\Z", "", "\n".join(own)), [(n, squeeze("\n".join(x))) for n, x in runs if squeeze("\n".join(x))]

    parsed = [(*m, *parse(m[3])) for m in messages]
    first: dict = {}
    for conv, turn, _, text, own, _ in parsed:
        if own and turn is not None and conv is not None:
            lines = [x for x in map(squeeze, re.split(BREAK, own)) if x]
            spans = [" ".join(lines[i:k]) for i in range(len(lines)) for k in range(i + 1, len(lines) + 1)]
            for unit in [own, *re.split(r"\r?\n[ \t]*\r?\n", own), *re.split(QUOTED_LINE.replace(r"\z", r"\Z"), text), *spans]:
                if u := squeeze(unit):
                    first[conv, u] = min(turn, first.get((conv, u), turn))
    out, up = [], {}
    for conv, turn, role, _, own, quoted in parsed:
        hits = [(n, -first[conv, q]) for n, q in quoted if (conv, q) in first and turn is not None and first[conv, q] < turn]
        parent = -min(hits)[1] if hits else None
        if parent is not None:
            up[conv, turn] = min(parent, up.get((conv, turn), parent))
        out.append([conv, turn, role, own, parent, len(quoted), len(hits), max((n for n, _ in quoted), default=0)])
    done = []
    for conv, turn, role, own, parent, n, linked, level in out:
        thread, depth = (turn, 0) if parent is None else (parent, 1)
        while parent is not None and (conv, thread) in up:
            thread, depth = up[conv, thread], depth + 1
        done.append((conv, turn, role, own, parent, thread, depth, n, linked, level))
    return done
