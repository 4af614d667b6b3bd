"""Listing of source trees by the tasks, folder by folder, with the ignore rules that lie in the folders."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import discard, materialize

#: Name of the files with ignore rules, and how many folders a task lists.
RULES, FOLDERS = ".gitignore", 32
ENTRY = "path string, is_folder boolean, size long, rules array<struct<base: string, line: string>>"


def as_rule(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """Expression for a path below the rules' folder, whether it takes back, and whether it is for folders alone."""
    text = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n"))
    if not text or text.startswith("#"):
        return None
    back = text.startswith("!")
    text = text[1:] if back else text
    only_folders, text = text.endswith("/"), text.rstrip("/")
    anchored, text = "/" in text, text.lstrip("/")
    out, at = "", 0
    while at < len(text):
        rest = text[at:]
        if rest.startswith("**/") and (at == 0 or text[at - 1] == "/"):
            out, at = out + "(?:[^/]+/)*", at + 3
        elif rest == "**" and at and text[at - 1] == "/":
            out, at = out + ".+", at + 2
        elif rest[0] == "*":
            out, at = out + "[^/]*", at + 1
        elif rest[0] == "?":
            out, at = out + "[^/]", at + 1
        elif rest[0] == "[" and (end := text.find("]", at + 2)) > 0:
            inner = text[at + 1 : end].replace("\\", "\\\\")
            out, at = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif rest[0] == "\\" and len(rest) > 1:
            out, at = out + re.escape(rest[1]), at + 2
        else:
            out, at = out + re.escape(rest[0]), at + 1
    return re.compile((out if anchored else "(?:.*/)?" + out) + r"\Z"), back, only_folders


def is_left_out(path: str, is_folder: bool, rules: list[tuple[str, tuple]]) -> bool:
    """Whether the last of the rules, from the root downwards, that matches a path leaves it out."""
    for base, (pattern, back, only_folders) in reversed(rules):
        if (is_folder or not only_folders) and pattern.match(path[len(base) :]):
            return not back
    return False


def open_folder(root: str):
    """The file system and path of a root, in a task."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", root) if root.startswith("file:") else root)


def list_tree(spark: SparkSession, root: str, ignored: tuple[str, ...] = (), follow_rules: bool = True) -> DataFrame:
    """path (from the root) and size of every file below ``root``, hidden and underscored ones too, in no order.

    A round lists the folders of one depth, ``FOLDERS`` in a task; the driver learns how many there are. Folders of an
    ``ignored`` name are not entered. With ``follow_rules`` the ignore files of a folder hold for all below it: of the
    rules above a path the last that matches decides, and nothing below a folder that is left out comes back. Links to
    folders are not followed. What a round found is written, so a lost executor costs no more than a round.
    """

    def list_some(batches: Iterator) -> Iterator:
        import os

        import pandas as pd
        from pyarrow import fs

        store, top = open_folder(root)
        for batch in batches:
            out = []
            for folder, inherited in zip(batch["path"], batch["rules"], strict=True):
                here = f"{folder}/" if folder else ""
                rules = [(r["base"], r["line"]) for r in inherited]
                entries = store.get_file_info(fs.FileSelector(f"{top}/{folder}".rstrip("/") or "/"))
                if follow_rules and any(e.base_name == RULES and e.type == fs.FileType.File for e in entries):
                    with store.open_input_file(f"{top}/{here}{RULES}") as file:
                        rules += [(here, line) for line in file.read().decode(errors="replace").splitlines()]
                ready = [(base, made) for base, line in rules if (made := as_rule(line))]
                for entry in entries:
                    path, is_folder = here + entry.base_name, entry.type == fs.FileType.Directory
                    if (is_folder and (entry.base_name in ignored or isinstance(store, fs.LocalFileSystem) and os.path.islink(entry.path))) or is_left_out(path, is_folder, ready):
                        continue
                    if is_folder or entry.type == fs.FileType.File:
                        out.append((path, is_folder, entry.size, [{"base": b, "line": x} for b, x in rules] if is_folder else []))
            yield pd.DataFrame(out, columns=["path", "is_folder", "size", "rules"])

    folders = spark.createDataFrame([("", [])], "path string, rules array<struct<base: string, line: string>>")
    found, n = [], 1
    while n:
        level = materialize(folders.repartition(-(-n // FOLDERS)).mapInPandas(list_some, ENTRY), "listing")
        found.append(level)
        folders = level.where("is_folder").select("path", "rules")
        n = folders.count()
    files = materialize(reduce(DataFrame.unionAll, (level.where("not is_folder").select("path", "size") for level in found)), "listing")
    discard(*found)
    return files


def read_files(files: DataFrame, root: str) -> DataFrame:
    """path and content (bytes) of ``files(path, size)`` below ``root``, dealt out by their paths and read by the tasks."""

    def read(batches: Iterator) -> Iterator:
        import pandas as pd

        store, top = open_folder(root)
        for batch in batches:
            for path in batch["path"]:
                with store.open_input_file(f"{top}/{path}") as file:
                    yield pd.DataFrame({"path": [path], "content": [file.read()]})

    return files.select("path").repartition("path").mapInPandas(read, "path string, content binary")


def write_tree(tree: DataFrame, root: str) -> None:
    """Write ``tree(path, content)`` as files below ``root``, each by the task that has its row; a retried task writes the same."""

    def write(batches: Iterator) -> Iterator:
        import pandas as pd

        store, top = open_folder(root)
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                store.create_dir(f"{top}/{path}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{top}/{path}") as file:
                    file.write(content.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    tree.select("path", "content").mapInPandas(write, "n long").agg(F.sum("n")).collect()
