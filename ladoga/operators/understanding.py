"""Understanding questions and dialogs by rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladoga.functions.text import CODE, YEARS, folded, found, tokens

#: Words by which a topic is recognised: parts of folded text. A topic earlier in the list wins a tie.
TOPICS: dict[str, list[str]] = {
    "admission": ["поступ", "принима", "зачисл", "проходной", "абитур", "admission", "anmeld"],
    "payment": ["стоит", "стоимост", "оплат", "рассрочк", "рублей", "платить", "fee"],
    "schedule": ["расписан", "начинается", "во сколько", "timetable", "schedule"],
    "dormitory": ["общежит", "dormitory"],
    "documents": ["документ", "приказ", "справк", "договор"],
    "practice": ["практик", "internship"],
    "exams": ["экзамен", "зачет", "пересдач", "exam"],
    "staff": ["отвечает", "преподавател", "куратор", "teacher"],
    "specialty": ["специальност", "обучение на"],
}
GREETINGS = ["здравствуйте", "добрый день", "привет", "hello", "guten tag"]
CONDITIONS: dict[str, list[str]] = {"after_9": ["после 9"], "after_11": ["после 11"], "budget": ["бюджет"], "paid": ["платн", "рассрочк"], "distance": ["дистанц", "заочн"]}
FOLLOW_UPS = ["а", "и", "это", "там", "тогда", "они", "он", "она"]


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words the text contains."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words[1:]), F.contains(text, F.lit(words[0])).cast("int"))


def topic(text: Column, topics: dict[str, list[str]] = TOPICS) -> Column:
    """The topic with most of its words in the text, null if none has any."""
    t = folded(text)
    scored = [(name, hits(t, words)) for name, words in topics.items()]
    best = F.greatest(*[n for _, n in scored])
    out = F.when(best == 0, F.lit(None).cast("string"))
    for name, n in scored:
        out = out.when(n == best, name)
    return out


def entities(text: Column) -> Column:
    """A map of what a question names: code, academic year, group, course."""
    found_ = {
        "code": F.get(found(text, CODE), F.lit(0)),
        "year": F.get(found(text, YEARS), F.lit(0)),
        "group": F.regexp_extract(F.upper(text), "(?<![А-ЯЁA-Z])([А-ЯЁA-Z]{2}-\\d{2})(?!\\d)", 1),
        "course": F.regexp_extract(F.lower(text), "(\\d) курс", 1),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.nullif(v, F.lit("")).alias("value")) for k, v in found_.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def conditions(text: Column, rules: dict[str, list[str]] = CONDITIONS) -> Column:
    t = folded(text)
    each = F.array(*[F.when(hits(t, words) > 0, F.lit(name)) for name, words in rules.items()])
    return F.filter(each, lambda c: c.isNotNull())


def intent(questions: DataFrame, text: str = "text") -> DataFrame:
    """``questions`` with topic, entities, conditions, and whether it greets, follows up on the turn before, is vague."""
    c = F.coalesce(F.col(text), F.lit(""))
    words = tokens(c)
    greeting = F.exists(F.array(*[F.lit(g) for g in GREETINGS]), lambda g: F.startswith(folded(c), g))
    follow = F.coalesce(F.get(words, F.lit(0)).isin(FOLLOW_UPS), F.lit(False))
    vague = (F.size(words) < 3) | (topic(c).isNull() & (F.size(F.map_keys(entities(c))) == 0))
    return (
        questions.withColumn("topic", topic(c)).withColumn("entities", entities(c)).withColumn("conditions", conditions(c))
        .withColumn("greeting", greeting).withColumn("follow_up", follow).withColumn("vague", vague)
    )


def synonym_expansion(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``query_id, term`` with the synonyms of each term added, each once. ``synonyms``: term, synonym."""
    more = terms.join(F.broadcast(synonyms), "term").select("query_id", F.col("synonym").alias("term"))
    return terms.unionByName(more).distinct()


def clarified(turns: DataFrame, within: str = "30 minutes") -> DataFrame:
    """``turn_id, answers, question, pending`` of turns ``turn_id, session_id, user_message, is_ambiguous, turn_ts``."""
    before = F.struct(F.col("is_ambiguous").alias("open"), "user_message", F.col("turn_ts").alias("at"))
    last = F.get("previous", F.lit(0))
    soon = F.col("turn_ts") <= last["at"] + F.expr(f"interval {within}")
    answers = F.coalesce(F.coalesce(last["open"], F.lit(False)) & soon, F.lit(False))
    both = F.when(answers, F.concat_ws(" ", last["user_message"], F.col("user_message"))).otherwise(F.col("user_message"))
    rows = with_previous(turns, "session_id", "turn_ts", "turn_id", 1, before)
    return rows.select("turn_id", answers.alias("answers"), both.alias("question"), F.coalesce("is_ambiguous", F.lit(False)).alias("pending"))


def with_previous(turns: DataFrame, key: str, at: str, tie: str, n: int, value: Column) -> DataFrame:
    """``turns`` with ``previous``: the values of the ``n`` rows of the same key before, oldest first.

    A key may hold a third of all rows, so windows run over months of a key; the last ``n`` rows of each month are handed
    on to the months after it, through those tails alone.
    """
    row = F.struct(F.col(at), F.col(tie), value.alias("value"))
    turns = turns.withColumn("_part", F.date_trunc("month", F.col(at)))
    w = Window.partitionBy(key, "_part").orderBy(at, tie)
    own = turns.withColumn("_own", F.collect_list(row).over(w.rowsBetween(-n, -1)))
    last = turns.withColumn("_row", row).withColumn("_n", F.row_number().over(Window.partitionBy(key, "_part").orderBy(F.desc(at), F.desc(tie)))).where(F.col("_n") <= n)
    tails = last.groupBy(key, "_part").agg(F.array_sort(F.collect_list("_row")).alias("_tail"))
    months = Window.partitionBy(key).orderBy("_part").rowsBetween(-n, -1)
    before = tails.select(key, "_part", F.flatten(F.collect_list("_tail").over(months)).alias("_before"))
    joined = own.join(before, [key, "_part"], "left").withColumn("_all", F.concat(F.coalesce("_before", F.array().cast(before.schema["_before"].dataType)), "_own"))
    kept = F.when(F.size("_all") > n, F.slice("_all", F.size("_all") - n + 1, n)).otherwise(F.col("_all"))
    return joined.withColumn("previous", F.transform(kept, lambda r: r["value"])).drop("_part", "_own", "_before", "_all")
