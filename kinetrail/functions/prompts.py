"""Prompts and targets of memory rows. Headers are parameters; memories and labels are maps of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .jsontext import dump_yaml
from .text import strip_text

# The fields of a memory in order, and the names of the two images.
FIELDS = ("Action_Command", "Working_Memory", "Episodic_Context")
TARGET = ("Working_Memory", "Episodic_Context", "Action_Command")
IMAGES = ("<image_table>", "<image_wrist>")


def memory_line(memory: Column) -> Column:
    """``field: value`` of the three fields in one line; absent ones, and those of a null memory, read None."""
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{k}: "), F.coalesce(memory[k], F.lit("None"))) for k in FIELDS])


def image_names(n: Column) -> Column:
    """Both names for two images, else the first."""
    return F.when(n == 2, F.lit(" ".join(IMAGES))).otherwise(F.lit(IMAGES[0]))


def detect_prompt(header: str, task: Column, memory: Column, n_images: Column) -> Column:
    """Header, task, memory and images, a line each; a null task is empty."""
    return F.concat(F.lit(f"{header}\nTask: "), F.coalesce(task, F.lit("")), F.lit("\nMemory: "), memory_line(memory), F.lit("\nImages: "), image_names(n_images), F.lit("\n"))


def update_prompt(header: str, task: Column, memory: Column, n_images: Column, commands: Column, line_end: bool = True) -> Column:
    """As ``detect_prompt`` with the memory before, and a block of commands unless they are blank or null."""
    listed = strip_text(commands)
    block = F.when(listed != "", F.concat(F.lit("\nAllowed_Action_Commands:\n"), listed, F.lit("\n"))).otherwise(F.lit(""))
    parts = [F.lit(f"{header}\nTask: "), F.coalesce(task, F.lit("")), F.lit("\nPrevious_Memory: "), memory_line(memory), F.lit("\n"), block, F.lit("Images: "), image_names(n_images)]
    return F.concat(*parts, F.lit("\n" if line_end else ""))


def memory_yaml(memory: Column) -> Column:
    """A ``key: value`` line per entry in the map's order, null values as ``null``; empty for an empty or null map."""
    lines = F.transform(F.map_entries(memory), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("null"))))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def last_said(turns: Column, who: str) -> Column:
    """The last text of a speaker in array<struct<from,value>>; null if it never spoke."""
    return F.try_element_at(F.transform(F.filter(turns, lambda t: t["from"] == who), lambda t: t["value"]), F.lit(-1))


def prompt_and_target(mode: Column, instruction: Column, memory: Column, label: Column, allowed: Column, turns: Column, headers: dict[str, str]) -> Column:
    """Struct (prompt, target) of a row by its mode: ``detect``, ``update``, else the last user's and assistant's texts.

    ``label`` is a map of texts; an event is detected if it reads true in any case. Null commands leave their block
    out, an empty list leaves it empty. A row of another mode without both texts is an error.
    """
    task, before = strip_text(instruction), memory_yaml(memory)
    head = lambda kind, name: F.concat(F.lit(f"{headers[kind]}\nGlobal_Instruction:\n"), task, F.lit(f"\n\n{name}:\n"), before)
    listed = F.when(allowed.isNull(), F.lit("")).otherwise(F.concat(F.lit("\n\nAllowed_Action_Commands:\n"), F.array_join(F.transform(allowed, lambda x: F.concat(F.lit("- "), x)), "\n")))
    detected = F.coalesce(F.lower(label["Event_Detected"]) == "true", F.lit(False))
    said, answered = last_said(turns, "user"), last_said(turns, "assistant")
    pair = lambda prompt, target: F.struct(prompt.alias("prompt"), target.alias("target"))
    broken = F.raise_error(F.concat(F.lit("neither a mode nor both texts: "), F.coalesce(mode, F.lit("null")))).cast("string")
    spoken = F.coalesce(said != "", F.lit(False)) & F.coalesce(answered != "", F.lit(False))
    legacy = pair(F.when(spoken, said).otherwise(broken), answered)
    here = lambda k: F.coalesce(F.map_contains_key(label, k), F.lit(False))
    after = dump_yaml({k: F.when(here(k), F.coalesce(label[k], F.lit("null"))).otherwise(F.lit("")) for k in TARGET})
    return (
        F.when(mode == "detect", pair(head("detect", "Current_Memory"), dump_yaml({"Event_Detected": detected})))
        .when(mode == "update", pair(F.concat(head("update", "Prev_Memory"), listed), after))
        .otherwise(legacy)
    )
