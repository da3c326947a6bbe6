"""Report catalog and crop plan.

Input is a file listing (``path`` plus optionally ``page_count``), e.g. the
``binaryFile`` source without its ``content`` column. Everything is column
expressions over the listing, one ``min`` aggregate for the team folder, an
equality join of substrings for the folders of many teams, a ``row_number`` per
folder for the running image index and a broadcast join with the crop spec (a
fixed ten rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pitchside import presets
from pitchside.functions.sql import dbl, lit_str, q, run_sql
from pitchside.functions.text import contains_ci_sql, first_word_sql, py_strip_sql
from pitchside.session import ensure_checkpoint_dir

SPEC_SCHEMA = ("team_slot int, crop_no int, side string, kind string, page_base int, shifts boolean, "
               "x0 int, y0 int, x1 int, y1 int, rounding string")


def with_parts(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Derive ``folder`` (parent directory name) and ``file`` (base name)."""
    p = f"split({q(path_col)}, '/')"
    return files.selectExpr("*", f"get({p}, size({p}) - 2) AS folder", f"get({p}, size({p}) - 1) AS file")


def with_page_counts(files: DataFrame, pages: DataFrame, path_col: str = "path") -> DataFrame:
    """The listing with ``page_count`` from a table ``(path, page_count)``, as pages are only known to whoever opened
    the report; NULL where the table lacks it."""
    counts = pages.groupBy(path_col).agg({"page_count": "max"}).withColumnRenamed("max(page_count)", "page_count")
    return files.join(counts, path_col, "left")


def _folder_sql(team: str) -> str:
    word = f"lower({first_word_sql(lit_str(team))})"
    return f"SELECT min(folder) AS folder FROM {{f}} WHERE contains(lower(folder), {word}) HAVING min(folder) IS NOT NULL"


def find_team_folder(files: DataFrame, team: str) -> DataFrame:
    """The first folder (by name) whose name contains the first word of
    ``team``, case-insensitive; zero rows when none does."""
    return run_sql({"f": files}, _folder_sql(team))


def _parts_step(path_col: str) -> tuple[str, str]:
    p = f"split({q(path_col)}, '/')"
    return ("f", f"SELECT *, get({p}, size({p}) - 2) AS folder, get({p}, size({p}) - 1) AS file FROM {{files}}")


def _slot_steps(team: str, own_team: str, suffix: str) -> list[tuple[str, str]]:
    """C2-C5 on the rows of ``found`` (a listing with ``folder`` and ``file``); ``team`` is SQL text."""
    parts = "split(file, '-')"
    return [
        ("teams", f"""SELECT *, {py_strip_sql(f'get({parts}, 0)')} AS team_1, {py_strip_sql(f'get({parts}, 1)')} AS team_2
FROM {{found}} WHERE endswith(file, {lit_str(suffix)}) AND NOT {contains_ci_sql('file', lit_str(own_team))}"""),
        ("slots", f"""SELECT *, CASE WHEN team_2 IS NULL THEN NULL WHEN contains(team_1, {team}) THEN 1
                         WHEN contains(team_2, {team}) THEN 2 END AS team_slot FROM {{teams}}"""),
    ]


def _kept(df: DataFrame, materialize: bool) -> DataFrame:
    if not materialize:
        return df
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def report_catalog(files: DataFrame, team: str, own_team: str = presets.OWN_TEAM,
                   path_col: str = "path", suffix: str = ".pdf", materialize: bool = True) -> DataFrame:
    """The reports of ``team``'s folder with slots and image index.

    Files of the own team are filtered out (the reference deletes them). The
    suffix test is case-sensitive. Teams are the stripped parts 0 and 1 of the
    file name split on '-'; a name without '-' has no team 2 and is skipped.
    ``team`` in part 1 gives slot 1, else in part 2 slot 2 (case-sensitive
    substring); other files are skipped. ``image_index`` counts matched
    reports per folder in file-name order, from 1.

    The listing is read once: what lies in folders with the team's first word is
    kept in the checkpoint folder (``materialize``), and the first folder and its
    files are taken from there.
    """
    t = lit_str(team)
    word = f"lower({first_word_sql(t)})"
    near = _kept(run_sql({"files": files}, f"SELECT * FROM {{f}} WHERE contains(lower(folder), {word})", [_parts_step(path_col)]), materialize)
    steps = [("found", "SELECT * FROM {near} WHERE folder = (SELECT min(folder) FROM {near})"), *_slot_steps(t, own_team, suffix)]
    sql = f"""SELECT *, CASE WHEN team_slot = 1 THEN team_2 ELSE team_1 END AS other_team,
       CAST(row_number() OVER (PARTITION BY folder ORDER BY file, {q(path_col)}) AS INT) AS image_index,
       {t} AS team
FROM {{slots}} WHERE team_slot IS NOT NULL"""
    return run_sql({"near": near}, sql, steps)


def team_folders(folders: DataFrame, teams: DataFrame, team_col: str = "team") -> DataFrame:
    """C1 for many teams at once: ``team, folder``, the first folder (by name) that contains the first word of each team.

    Every distinct folder name gives its substrings of the lengths that the words have, and these meet the words by equality,
    so the work is folders x name length x distinct lengths however many teams there are."""
    word = f"lower({first_word_sql(q(team_col))})"
    steps = [
        ("w", f"SELECT DISTINCT {q(team_col)} AS team, {word} AS word FROM {{teams}} WHERE {word} <> ''"),
        # lengths of first words: a handful of numbers
        ("d", "SELECT folder, lower(folder) AS low, (SELECT array_distinct(collect_set(length(word))) FROM {w}) AS sizes FROM (SELECT DISTINCT folder FROM {folders})"),
        ("n", "SELECT folder, low, explode(filter(sizes, n -> n <= length(low))) AS n FROM {d}"),
        ("s", "SELECT folder, substring(low, i, n) AS word FROM {n} LATERAL VIEW explode(sequence(1, length(low) - n + 1)) t AS i"),
        ("first", "SELECT s.word, min(s.folder) AS folder FROM {s} s LEFT SEMI JOIN {w} w ON s.word = w.word GROUP BY s.word"),
    ]
    return run_sql({"folders": folders, "teams": teams}, "SELECT w.team, first.folder FROM {w} w JOIN {first} first ON w.word = first.word", steps)


def report_catalogs(files: DataFrame, teams: DataFrame, own_team: str = presets.OWN_TEAM, path_col: str = "path", suffix: str = ".pdf",
                    team_col: str = "team", name_col: str | None = None, materialize: bool = True) -> DataFrame:
    """C1-C5, C8 for every row of ``teams`` in one job: ``report_catalog`` of each team, with the column ``team``.

    ``name_col``: the team as file names spell it (default: the team itself). Teams of one folder share its rows; a team
    without a folder has none. The listing is kept once in the checkpoint folder (``materialize``)."""
    listing = _kept(run_sql({"files": files}, "SELECT * FROM {f}", [_parts_step(path_col)]), materialize)
    chosen = team_folders(listing.select("folder"), teams, team_col)
    name = q(name_col or team_col)
    steps = [("names", f"SELECT DISTINCT {q(team_col)} AS __team, {name} AS __name FROM {{teams}}"),
             ("found", "SELECT l.*, c.team, n.__name FROM {listing} l JOIN {chosen} c ON l.folder = c.folder JOIN {names} n ON c.team = n.__team"),
             *_slot_steps("__name", own_team, suffix)]
    sql = f"""SELECT * EXCEPT (__name), CASE WHEN team_slot = 1 THEN team_2 ELSE team_1 END AS other_team,
       CAST(row_number() OVER (PARTITION BY team, folder ORDER BY file, {q(path_col)}) AS INT) AS image_index
FROM {{slots}} WHERE team_slot IS NOT NULL"""
    return run_sql({"listing": listing, "chosen": chosen, "teams": teams}, sql, steps)


def crop_spec_frame(spark: SparkSession) -> DataFrame:
    """The fixed crop spec, one row per (team slot, cut)."""
    rows = [(slot, no, side, kind, base, shifts, *rect, "trunc")
            for slot, no, side, kind, base, shifts, rect in presets.CROP_SPEC]
    side, kind, base, shifts, rect = presets.FORMATION_CROP
    rows += [(slot, 5, side, kind, base, shifts, *rect, "round") for slot in (1, 2)]
    return spark.createDataFrame(rows, SPEC_SCHEMA)


def _spec_values_sql() -> str:
    rows = [(slot, no, side, kind, base, shifts, *rect, "trunc")
            for slot, no, side, kind, base, shifts, rect in presets.CROP_SPEC]
    side, kind, base, shifts, rect = presets.FORMATION_CROP
    rows += [(slot, 5, side, kind, base, shifts, *rect, "round") for slot in (1, 2)]
    vals = ", ".join("(" + ", ".join(lit_str(v) if isinstance(v, str) else str(v).upper() if isinstance(v, bool)
                                     else str(v) for v in r) + ")" for r in rows)
    names = ", ".join(c.split()[0] for c in SPEC_SCHEMA.split(", "))
    return f"(SELECT * FROM VALUES {vals} AS spec({names}))"


def crop_plan(catalog: DataFrame, dpi: int = presets.DPI, base_dpi: int = presets.BASE_DPI,
              page_count_col: str = "page_count") -> DataFrame:
    """One row per cut of every catalogued report.

    Page (0-based) = base page, shifted by ``page_count - 24`` for the
    shooting-map pages. Rectangles are scaled by ``dpi / 72``; the four
    shooting cuts truncate (``int``), the formation cut rounds half-even like
    the image library does with float boxes. Output names follow the output
    *directory* kinds.
    """
    scale = dbl(dpi / base_dpi)

    def px(c: str) -> str:
        v = f"(CAST(s.{c} AS DOUBLE) * {scale})"
        return f"CAST(CASE WHEN s.rounding = 'round' THEN bround({v}, 0) ELSE {v} END AS INT) AS {c}"

    idx = "CAST(c.image_index AS STRING)"
    own_first = f"concat(s.kind, '_', {idx}, '_', c.team, '_against_', c.other_team, '.png')"
    other_first = f"concat(s.kind, '_', {idx}, '_', c.other_team, '_against_', c.team, '.png')"
    form = f"concat(s.kind, '_', {idx}, '_', c.team_1, '_', c.team_2, '.png')"
    sql = f"""SELECT /*+ BROADCAST(s) */ c.folder, c.file, c.image_index, s.crop_no, s.side, s.kind,
       s.page_base + CASE WHEN s.shifts THEN c.{q(page_count_col)} - {presets.BASE_PAGE_COUNT} ELSE 0 END AS page,
       {px('x0')}, {px('y0')}, {px('x1')}, {px('y1')},
       CASE WHEN s.kind = 'avg_formation' THEN {form} WHEN s.side = 'home_team' THEN {own_first}
            ELSE {other_first} END AS out_name
FROM {{catalog}} c JOIN {_spec_values_sql()} s ON c.team_slot = s.team_slot"""
    return run_sql({"catalog": catalog}, sql)
