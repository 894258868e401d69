"""Documents of an index: the overview with its diagrams and budgeted file table, details per module, the history.

Lines are made by expressions and ordered per document; only finished documents, which a budget or a module bounds, reach the driver.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.functions import text
from loomdex.operators import changes, graph, working_set

FIXED_TOKENS = 400


def file_rows(files: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """path, language, role, symbols, in_degree, and the file's line in the overview."""
    counts = symbols.groupBy(F.col("file").alias("path")).agg(F.count("*").alias("symbols"))
    degree = graph.in_degree(refs).withColumnRenamed("dst_file", "path")
    rows = files.select("path", "language", "role").join(counts, "path", "left").join(degree, "path", "left").na.fill(0, ["symbols", "in_degree"])
    return rows.withColumn("line", F.format_string("| `%s` | %s | %s | %d |", "path", "language", "role", "symbols"))


def kept_rows(rows: DataFrame, most: int | None) -> DataFrame:
    """The rows that an overview of ``most`` tokens shows: by in-degree, each that still fits; all without a budget."""
    if most is None:
        return rows
    priced = rows.withColumn("cost", text.estimate_tokens(F.col("line"))).withColumn("less", -F.col("in_degree"))
    return rows.where(F.col("path").isin(working_set.greedy_walk(priced, most - FIXED_TOKENS, ["less", "path"], "cost", "path")))


def directory_diagram(files: DataFrame) -> list[str]:
    edges = graph.tree_edges(files).select("parent", "child", text.node_id("d", F.when(F.col("parent") == "", "__root__").otherwise(F.col("parent"))).alias("a"), text.node_id("d", F.col("child")).alias("z"), text.label(F.element_at(F.split("child", "/"), -1), 32).alias("name"))
    rows = edges.orderBy("child").collect()
    root = files.sparkSession.range(1).select(text.node_id("d", F.lit("__root__"))).first()[0]
    return ["graph TD", f'    {root}["/"]', *[x for r in rows for x in (f'    {r.z}["{r.name}"]', f"    {r.a} --> {r.z}")]]


def edge_diagram(edges: DataFrame, nodes: DataFrame, most: int, src: str, dst: str, prefix: str, separator: str, head: list[str], empty: str) -> list[str]:
    """The heaviest edges between known nodes."""
    name = lambda c: text.label(F.element_at(F.split(F.col(c), separator), -1), 32)
    total = graph.top_edges(edges, most + 1, nodes, src, dst).select(text.node_id(prefix, F.col(src)).alias("a"), name(src).alias("an"), text.node_id(prefix, F.col(dst)).alias("z"), name(dst).alias("zn"), "count").collect()
    lines, seen = list(head), set()
    for r in total[:most]:
        for node, label in ((r.a, r.an), (r.z, r.zn)):
            if node not in seen:
                seen.add(node)
                lines.append(f'    {node}["{label}"]')
        lines.append(f'    {r.a} -->|"{r["count"]}"| {r.z}')
    if len(total) > most:
        lines.append(f'    more["… {most}+ edges"]')
    return lines if total else [*head, f'    empty["{empty}"]']


def inheritance_diagram(symbols: DataFrame) -> list[str]:
    classes = symbols.where(F.col("kind").isin("class", "interface")).select("qualified_name", text.node_id("c", F.col("qualified_name")).alias("id"), text.label(F.col("name"), 40).alias("name")).orderBy("qualified_name").collect()
    if not classes:
        return ["classDiagram", "    class EmptyProject"]
    edges = graph.inheritance(symbols).select(text.node_id("c", F.col("child")).alias("child"), F.when(F.col("parent").isNotNull(), text.node_id("c", F.col("parent"))).alias("parent"), text.label(F.col("base"), 30).alias("base")).orderBy("child", "base").collect()
    lines = ["classDiagram", *[x for c in classes for x in (f"    class {c.id} {{", f"        {c.name}", "    }")]]
    return lines + [f"    {e.parent} <|-- {e.child}" if e.parent else f'    note for {e.child} "extends {e.base}"' for e in edges]


def overview(t: dict[str, DataFrame], most: int | None = None) -> str:
    """The overview document of an index."""
    files, symbols, refs, edges = t["files"], t["symbols"], t["refs"], t["call_edges"]
    rows = file_rows(files, symbols, refs)
    shown, total = kept_rows(rows, most).orderBy("path").select("line").collect(), files.count()
    diagrams = {
        "Tree": directory_diagram(files), "Dependencies": edge_diagram(refs, files.select(F.col("path").alias("node")), 60, "src_file", "dst_file", "m", "/", ["flowchart LR"], "no internal dependencies"),
        "Inheritance": inheritance_diagram(symbols), "Calls": edge_diagram(edges, symbols.select(F.col("qualified_name").alias("node")).distinct(), 40, "src_qname", "dst_qname", "cg", r"\.", ["%% approximate", "flowchart TD"], "no resolved call edges"),
    }
    lines = ["---", f"files: {total}", f"symbols: {symbols.count()}", "---", "", "# Overview", ""]
    for name, body in diagrams.items():
        lines += [f"## {name}", "", "```mermaid", *body, "```", ""]
    lines += ["## Files", "", "| file | language | role | symbols |", "|---|---|---|---|", *[r.line for r in shown]]
    return "\n".join(lines + ([f"", f"{total - len(shown)} file(s) left out to keep the budget."] if len(shown) < total else [])) + "\n"


def symbol_pages(symbols: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """page_id, file, callers, callees, related_files, content of every symbol: whole tables of pages in one job."""
    own = symbols.groupBy(F.col("qualified_name").alias("page_id")).agg(F.min(F.struct("file", "line", "signature", "description")).alias("s")).select("page_id", "s.*")
    names = lambda df, key, value, out: df.groupBy(F.col(key).alias("page_id" if out != "related_files" else "file")).agg(F.array_sort(F.collect_set(value)).alias(out))
    near = own.join(names(edges, "dst_qname", "src_qname", "callers"), "page_id", "left").join(names(edges, "src_qname", "dst_qname", "callees"), "page_id", "left")
    near = near.join(names(graph.related(refs), "node", "other", "related_files"), "file", "left")
    lists = {n: F.coalesce(n, F.array().cast("array<string>")) for n in ("callers", "callees", "related_files")}
    quoted = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")
    said = lambda n: F.when(F.size(lists[n]) > 0, F.concat(F.lit("\n" + n.replace("_", " ") + ": "), quoted(lists[n]), F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("### "), "page_id", F.lit("\n\n`"), "signature", F.lit("`\n\n"), "file", F.lit(":"), F.col("line").cast("string"), F.lit("\n\n"), F.coalesce("description", F.lit("")), F.lit("\n"))
    return near.select("page_id", "file", *[c.alias(n) for n, c in lists.items()], F.concat(head, *map(said, lists)).alias("content"))


def recent(names: DataFrame, most: int = 5) -> DataFrame:
    """The latest history documents, which their names order."""
    return names.select("name").distinct().orderBy(F.desc("name")).limit(most)


def details(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """name, module, content: one document per top-level module, its files and their symbols in order."""
    rows = symbols.join(files.select(F.col("path").alias("file"), F.col("role").alias("file_role")), "file").withColumn("module", text.top_module(F.col("file")))
    line = F.concat(F.lit("| `"), "qualified_name", F.lit("` | "), "kind", F.lit(" | `"), F.replace(F.col("signature"), F.lit("|"), F.lit("\\|")), F.lit("` | "), F.coalesce("description", F.lit("")), F.lit(" |"))
    per_file = rows.groupBy("module", "file", "file_role").agg(F.array_sort(F.collect_list(F.struct("line", "qualified_name", line.alias("said")))).alias("rows"))
    part = F.concat(F.lit("## "), "file", F.lit("\n\nrole: "), "file_role", F.lit("\n\n| symbol | kind | signature | description |\n|---|---|---|---|\n"), F.array_join("rows.said", "\n"))
    docs = per_file.groupBy("module").agg(F.array_sort(F.collect_list(F.struct("file", part.alias("part")))).alias("parts"))
    return docs.select(text.detail_name(F.col("module")).alias("name"), "module", F.concat(F.lit("# "), "module", F.lit("\n\n"), F.array_join("parts.part", "\n\n"), F.lit("\n")).alias("content"))


def write_details(docs: DataFrame, folder: str | Path) -> list[str]:
    """Write detail documents and remove those of modules that are gone."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    written = set()
    for r in docs.toLocalIterator():
        (folder / r.name).write_text(r.content, encoding="utf-8")
        written.add(r.name)
    for old in folder.glob("*-????????.md"):
        if old.name not in written:
            old.unlink()
    return sorted(written)


#: What the history document says, by language.
TITLES = {
    "en": {"title": "History", "none": "No changes yet.", "gap": "{} minutes passed since the update before; edits between may be missing."},
    "zh": {"title": "变更历史", "none": "暂无变更。", "gap": "距上次更新已过 {} 分钟；其间的修改可能缺失。"},
}


def history(log: DataFrame, minutes: int = 30, lang: str = "en") -> str:
    """The last update's changes by file, with a warning where updates were far apart."""
    said_in = TITLES.get(lang, TITLES["en"])
    last = log.agg(F.max("run_id")).first()[0]
    if last is None:
        return f"# {said_in['title']}\n\n{said_in['none']}\n"
    runs = log.groupBy("run_id").agg(F.max("ts").alias("ts")).withColumn("all", F.lit(1))
    gap = changes.gaps(runs, ["all"], "ts", minutes).where(F.col("run_id") == last).first()
    said = F.concat(F.lit("- "), "change_type", F.lit(" `"), "symbol", F.lit("`"), F.when(F.col("change_type") == "renamed", F.concat(F.lit(" (was `"), "old_value", F.lit("`)"))).when(F.col("change_type") == "signature_changed", F.concat(F.lit(": `"), "old_value", F.lit("` → `"), "new_value", F.lit("`"))).otherwise(""), F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit(" "), "detail")).otherwise(""))
    rows = log.where(F.col("run_id") == last).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("seq", said.alias("said")))).alias("rows")).orderBy("file").select("file", F.array_join("rows.said", "\n").alias("body")).collect()
    warning = ["> " + said_in["gap"].format(gap.gap_seconds // 60), ""] if gap else []
    return "\n".join([f"# {said_in['title']}", "", *warning, *[f"## {r.file}\n\n{r.body}\n" for r in rows]])
