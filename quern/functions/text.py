"""String functions of the evaluation and preparation steps, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANSWER_MARK = "Answer: "
NO_ANSWER = "?"


def extract_answer(text: Column) -> Column:
    """The character right after the last mark of the text without bold stars; ``?`` where there is none."""
    plain = F.replace(text, F.lit("**"), F.lit(""))
    found = F.left(F.substring_index(plain, ANSWER_MARK, -1), F.lit(1))
    return F.when(F.instr(plain, ANSWER_MARK) > 0, F.when(found == "", NO_ANSWER).otherwise(found)).otherwise(NO_ANSWER)


def letter_reward(text: Column) -> Column:
    """Share of the letter a, without case; 0 for an empty text."""
    low = F.lower(text)
    return F.when(F.length(low) > 0, (F.length(low) - F.length(F.replace(low, F.lit("a"), F.lit("")))) / F.length(low)).otherwise(F.lit(0.0))


def join_path(base: Column, path: Column) -> Column:
    """An absolute path replaces the base."""
    return F.when(F.startswith(path, F.lit("/")), path).when(F.endswith(base, F.lit("/")), F.concat(base, path)).otherwise(F.concat(base, F.lit("/"), path))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def below(path: Column, parts: int = 3) -> Column:
    """The path without its first parts."""
    pieces = F.split(path, "/")
    return F.array_join(F.slice(pieces, parts + 1, F.greatest(F.size(pieces) - parts, F.lit(0))), "/")


def kebab(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit("_"), F.lit("-")))


def host_port(address: Column, default: int) -> Column:
    """Struct of host and port; null port where it isn't in 1..65535."""
    tail = F.regexp_extract(address, r":([^:]*)$", 1)
    port = F.when(F.instr(address, ":") > 0, F.try_to_number(tail, F.lit("99999")).cast("int")).otherwise(F.lit(default))
    return F.struct(F.regexp_replace(address, r":[^:]*$", "").alias("host"), F.when(port.between(1, 65535), port).alias("port"))


#: The text before the question, and what follows the options.
ATTACHMENT_TOKEN = "<|reserved_special_token_0|>"
ANSWER_FORMAT = """Let's think step by step. Detail your reasoning before answering carefully. Your final answer should have the following format:

<reasoning leading to the answer>
Answer: <letter>

The <letter> is chosen amongst the possible options (A, B, C, D or E)
"""


def mcq_prompt(question: Column, options: list[tuple[str, Column]]) -> Column:
    """Question and its lettered options, one a line; null options are left out."""
    lines = F.array_compact(F.array(*(F.when(c.isNotNull(), F.concat(F.lit(f"{k}. "), c)) for k, c in options)))
    return F.concat(F.lit('\n"'), question, F.lit("\n"), F.array_join(lines, "\n"))


def mcq_request(question: Column, options: list[tuple[str, Column]], attachment: str = ATTACHMENT_TOKEN) -> Column:
    """The whole request: attachment token, question, options and the wanted form of the answer."""
    return F.concat(mcq_prompt(F.concat(F.lit(f"{attachment} "), question), options), F.lit("\n" + ANSWER_FORMAT))


def option_count(last: Column, most: int = 5) -> Column:
    """One less than the most where the last option is missing (null or not a number)."""
    missing = last.isNull() | (F.lower(last.cast("string")) == "nan")
    return F.when(missing, most - 1).otherwise(most)


def image_path(folder: Column, index: Column, suffix: str = "jpg") -> Column:
    return join_path(folder, F.format_string(f"%s.{suffix}", index.cast("string")))


def clean_caption(text: Column, token: str = "<attachment>") -> Column:
    return F.replace(text, F.lit(token), F.lit(""))


def letter_score(text: Column) -> Column:
    """Reward as a struct: score, and the fixed acc and pred that go with it."""
    return F.struct(letter_reward(text).alias("score"), F.lit(0.0).alias("acc"), F.lit("Maybe").alias("pred"))


def minute_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd-HH-mm")


def shouted(name: Column) -> Column:
    """Kebab case back to upper snake case."""
    return F.upper(F.replace(name, F.lit("-"), F.lit("_")))


def first_match(text: Column, rules: list[tuple[str, int]], otherwise: int) -> Column:
    """Label of the first rule whose string the text contains."""
    out = F.when(F.contains(text, F.lit(rules[0][0])), rules[0][1])
    for needle, label in rules[1:]:
        out = out.when(F.contains(text, F.lit(needle)), label)
    return out.otherwise(otherwise)
