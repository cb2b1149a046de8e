"""Column functions over file paths, questions and answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: file endings by use
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "bmp", "gif", "tiff")
CLASS_ENDINGS = ("png", "jpg", "jpeg", "bmp", "webp")
CONVERTED_ENDINGS = ("png", "bmp", "gif", "tiff", "webp")
KEPT_ENDINGS = ("jpg", "jpeg")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def folder(path: Column) -> Column:
    """The name of the folder that holds a file: its class."""
    return F.regexp_extract(path, "([^/]+)/[^/]+$", 1)


def ending(path: Column) -> Column:
    """The file name's ending in lower case, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]+)$", 1))


def is_image(path: Column, endings: tuple[str, ...] = IMAGE_ENDINGS) -> Column:
    return ending(path).isin(*endings)


def other_image(path: Column) -> Column:
    """An image that isn't of a kept format."""
    return is_image(path) & ~ending(path).isin(*KEPT_ENDINGS)


def with_ending(path: Column, new: str = "jpg") -> Column:
    return F.regexp_replace(path, r"\.[^./]+$", f".{new}")


def relative(path: Column, base: str) -> Column:
    """The path below `base` with forward slashes; whole if it is elsewhere."""
    path, base = F.regexp_replace(path, r"\\", "/"), base.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def numbered(name: Column, folder_name: Column) -> Column:
    """n of a file named folder + n + .jpg or .jpeg (any case), else null."""
    head = F.lower(F.substring(name, F.lit(1), F.length(folder_name))) == F.lower(folder_name)
    rest = F.substring(name, F.length(folder_name) + 1, F.length(name))
    return F.when(head, F.regexp_extract(rest, r"(?i)^([0-9]+)\.(?:jpg|jpeg)$", 1).try_cast("int"))


def normal_label(label: Column) -> Column:
    return F.lower(F.regexp_replace(label, "_", " "))


def says_yes(answer: Column) -> Column:
    """Whether an answer holds "yes", also inside a word."""
    return F.lower(answer).contains("yes")


def question(label: Column, article: str = "a") -> Column:
    return F.concat(F.lit(f"Is this an image of {article} "), label, F.lit("?"))


def question_category(text: Column, exact: dict[str, str], labels: list[str]) -> Column:
    """The class that a question is about: by exact template, else the first label (in the given order) found in it, else unknown."""
    known = [F.when(text == q, F.lit(c)) for q, c in exact.items()]
    inside = [F.when(F.lower(text).contains(c.lower()), F.lit(c)) for c in labels]
    return F.coalesce(*known, *inside, F.lit("unknown"))


def asked_after(text: Column, phrase: str = "contain a ") -> Column:
    """What stands after a phrase, without a closing question mark; null if the phrase is missing."""
    return F.when(text.contains(phrase), F.rtrim(F.get(F.split(text, phrase), F.lit(1)), F.lit("?")))


def pass_mark(score: Column, threshold: Column) -> Column:
    return F.when(score.isNotNull() & (score >= threshold), "yes").otherwise("no")


def easy_negative(path: Column, mark: str = "ez_negative") -> Column:
    """Whether a path bears the mark of an easy negative."""
    return path.contains(mark)


def relabelled(label: Column, targets: list[str], rest: str = "others") -> Column:
    """Labels as they are spelled in questions; those that aren't targets are all `rest`."""
    known = normal_label(label)
    return F.when(known.isin(*targets), known).otherwise(F.lit(rest))


def class_question(label: Column, templates: dict[str, str]) -> Column:
    """Each class's own question; a class without one is an error, no label has none."""
    out = F.when(label.isNull(), F.lit(None).cast("string"))
    for name, text in templates.items():
        out = out.when(label == name, F.lit(text))
    return out.otherwise(F.raise_error(F.concat(F.lit("no question for class "), label)).cast("string"))
