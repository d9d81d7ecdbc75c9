"""Written intermediate tables, and names of columns that don't clash."""

from __future__ import annotations

from pyspark.sql import DataFrame

from lexloom.functions.shared import LOCAL_DEFAULT, new_path, shared_dir, stored as written

__all__ = ["LOCAL_DEFAULT", "free_name", "new_path", "shared_dir", "without_clash", "written"]


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores in front until no column of df (in any case) has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without_clash(df: DataFrame, names: list[str]) -> DataFrame:
    """Drops columns of df that an operator's result columns replace."""
    gone = {n.lower() for n in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in gone])
