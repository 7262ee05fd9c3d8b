"""Names of columns that do not meet."""

from pyspark.sql import DataFrame


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind those that the table has already, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def set_apart(df: DataFrame, used: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """The table without columns of the names in ``used``, renamed, and how: old name -> new name."""
    clash = [c for c in df.columns if c.lower() in {u.lower() for u in used}]
    renamed = dict(zip(clash, free(df.select("*"), *(f"{c}__given" for c in clash)), strict=True))
    return df.withColumnsRenamed(renamed), renamed
