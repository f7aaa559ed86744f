"""Column functions over relative POSIX paths."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourceassay import fixed_values as fv


def contains_any(col: Column, fragments: Iterable[str]) -> Column:
    """True where ``col`` holds any fragment as a plain substring."""
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(f)) for f in fragments])


def pruned_dir(path: Column, dirs: Iterable[str]) -> Column:
    """Shortest ignored directory prefix of ``path``; '' when nothing is pruned.

    Only directory segments are tested, never the file name.
    """
    names = "|".join(re.escape(d) for d in dirs)
    return F.regexp_extract(path, rf"^((?:[^/]+/)*?(?:{names}))/", 1)


def suffix(path: Column) -> Column:
    """Last suffix with its dot; '' for dotfiles and names without one."""
    return F.regexp_extract(path, r"[^/](\.[^./]+)\z", 1)


def language(path: Column, extensions: Mapping[str, str] = fv.GENERAL_EXTENSIONS) -> Column:
    """Language tag of the path, null when the suffix is not on the list."""
    pairs = [F.lit(x) for pair in extensions.items() for x in pair]
    return F.create_map(*pairs)[suffix(path)]


def is_test(path: Column, track: str = "general") -> Column:
    markers = fv.SOLIDITY_TEST_MARKERS if track == "solidity" else fv.GENERAL_TEST_MARKERS
    return contains_any(path, markers)


def is_third_party(path: Column, track: str = "general") -> Column:
    solidity = track == "solidity"
    markers = fv.SOLIDITY_THIRD_PARTY_MARKERS if solidity else fv.GENERAL_THIRD_PARTY_MARKERS
    return contains_any(path, markers)


def is_relative(path: Column) -> Column:
    """Non-empty and neither POSIX-, drive-, UNC- nor home-absolute."""
    return F.coalesce((path != "") & ~path.rlike(fv.ABSOLUTE_PATH), F.lit(False))


def leaks_absolute_path(snippet: Column) -> Column:
    return contains_any(snippet, fv.LEAKED_PATHS) | snippet.rlike(fv.WINDOWS_DRIVE)


def relative_to(path: Column, root: Column) -> Column:
    """Drop ``root/`` from the front of ``path`` where it is there."""
    return F.when(
        F.startswith(path, F.concat(root, F.lit("/"))),
        path.substr(F.length(root) + 2, F.length(path)),
    ).otherwise(path)


def suggestion_path(path: Column, finding_id: Column) -> Column:
    """File a suggested patch is written to, next to the source file."""
    return F.concat(
        path, F.lit(".suggestion-"), F.coalesce(finding_id, F.lit("patch")), F.lit(".txt")
    )
