"""Files around a workspace: model catalogs, tool and prompt definitions, editing states, host logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# --- models -------------------------------------------------------------------------------------------------------

_PRICES = "struct<batch_size: double, default: struct<input_price: double, output_price: double, cache_price: double>>"
_MODELS = f"array<struct<id: string, name: string, vendor: string, model_picker_category: string, model_picker_price_category: string, is_chat_fallback: boolean, family: string, capabilities: struct<family: string>, billing: struct<token_prices: {_PRICES}>>>"


def models(files: DataFrame) -> DataFrame:
    """files: file, value (a JSON array of models). One row per id, the last in a file holding."""
    rows = files.select("file", F.posexplode(F.from_json("value", _MODELS)).alias("pos", "m"))
    best = rows.groupBy("file", F.col("m.id").alias("id")).agg(F.max_by("m", "pos").alias("m"), F.min("pos").alias("pos"))
    price = F.col("m.billing.token_prices")
    return best.select(
        "file", "id", "pos", "m.name", "m.vendor", F.coalesce("m.capabilities.family", "m.family", F.lit("unknown")).alias("family"), F.col("m.model_picker_category").alias("category"), F.col("m.model_picker_price_category").alias("price_category"), F.coalesce("m.is_chat_fallback", F.lit(False)).alias("fallback"),
        price["batch_size"].alias("batch_size"), price["default"]["input_price"].alias("input_price"), price["default"]["output_price"].alias("output_price"), price["default"]["cache_price"].alias("cache_price"),
    )


def find_models(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """wanted: model. The catalogued model of each: by id, else where one of name and id begins with the other, else by a family within the name; the first in the file of those. A catalog has some dozens of rows and is broadcast; names are joined by shuffle unless Spark knows them to be few."""
    names = wanted.select("model").where("model IS NOT NULL").distinct()
    known = F.broadcast(catalog.select("id", "family", "pos"))
    rank = F.when(F.col("model") == F.col("id"), 0).when(F.col("model").startswith(F.col("id")) | F.col("id").startswith(F.col("model")), 1).when(F.contains(F.col("model"), F.col("family")), 2)
    pairs = names.join(known, rank.isNotNull())
    best = pairs.groupBy("model").agg(F.min(F.struct(rank.alias("rank"), "pos", "id")).alias("b")).select("model", F.col("b.id").alias("model_id"))
    return wanted.join(best, "model", "left")


def cost(input_tokens: Column, output_tokens: Column, cached: Column) -> Column:
    """Dollars by the price columns beside; 0 without prices."""
    spent = F.greatest(input_tokens - cached, F.lit(0.0)) * F.col("input_price") + output_tokens * F.col("output_price") + cached * F.coalesce("cache_price", F.lit(0.0))
    return F.coalesce(spent / F.nullif(F.col("batch_size"), F.lit(0.0)), F.lit(0.0))


def lightweight() -> Column:
    return (F.col("category") == "lightweight") | (F.col("price_category") == "low") | F.col("fallback")


# --- tools and prompts --------------------------------------------------------------------------------------------

#: The tools of each category, matched whole whatever their case, and what names of a category begin with. The first category that fits holds.
TOOL_CATEGORIES = {
    "file": ["create_file", "create_directory", "read_file", "replace_string_in_file", "multi_replace_string_in_file", "file_search", "grep_search", "list_dir", "get_errors"],
    "browser": ["open_browser_page", "click_element", "drag_element", "hover_element", "read_page", "screenshot_page", "type_in_page", "navigate_page", "run_playwright_code", "handle_dialog"],
    "terminal": ["run_in_terminal", "send_to_terminal", "get_terminal_output", "kill_terminal", "terminal_last_command", "terminal_selection"],
    "memory": ["memory", "resolve_memory_file_uri"],
    "search": ["semantic_search", "grep_search", "file_search", "github_repo", "github_text_search"],
    "python": ["configure_python_environment", "get_python_environment_details", "get_python_executable_details", "install_python_packages"],
    "vscode": ["run_vscode_command", "get_vscode_api", "install_extension", "get_errors", "create_and_run_task", "get_task_output"],
    "task": ["manage_todo_list", "create_and_run_task", "get_task_output"],
    "subagent": ["runSubagent"],
    "web": ["fetch_webpage"],
    "notebook": ["create_new_jupyter_notebook", "edit_notebook_file", "read_notebook_cell_output", "run_notebook_cell", "copilot_getNotebookSummary"],
    "mcp": [],
}
TOOL_PREFIXES = {"python": "mcp_provides_tool_pylance", "vscode": "vscode_", "mcp": "mcp_provides_tool"}


def tool_category(name: Column) -> Column:
    folded = F.lower(name)
    fits = [F.when(folded.isin([n.lower() for n in names]) | (folded.startswith(TOOL_PREFIXES[c]) if c in TOOL_PREFIXES else F.lit(False)), F.lit(c)) for c, names in TOOL_CATEGORIES.items()]
    return F.coalesce(*fits, F.lit("unknown"))


def _content(value: Column) -> Column:
    return F.from_json(value, "struct<content: string>")["content"]


def tools(files: DataFrame) -> DataFrame:
    """files: file, value ({"content": JSON text of an array of tools}). One row per tool, with its category."""
    listed = F.from_json(_content(F.col("value")), "array<struct<name: string, description: string, function: struct<name: string, description: string>>>")
    rows = files.select("file", F.explode(listed).alias("t")).select("file", F.coalesce("t.name", "t.function.name").alias("name"), F.coalesce("t.description", "t.function.description").alias("description"))
    return rows.where("name IS NOT NULL").withColumn("category", tool_category(F.col("name")))


def tool_histogram(listed: DataFrame) -> DataFrame:
    return listed.groupBy("category").agg(F.count("*").alias("n"))


def prompt_texts(files: DataFrame) -> DataFrame:
    """files: file, value ({"content": JSON text of parts with text, or plain text}). The text of each prompt."""
    parts = F.from_json(_content(F.col("value")), "array<struct<content: string, text: string>>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], p["content"], F.lit(""))), "\n")
    return files.select("file", F.coalesce(F.when(F.size(parts) > 0, joined), _content(F.col("value"))).alias("text"))


def _child(block: Column, tag: str) -> Column:
    """The text of a block's first child with this tag; null where it has none or an empty one."""
    rest = F.get(F.split(block, f"<{tag}>", 2), F.lit(1))
    return F.nullif(F.trim(F.when(F.contains(rest, F.lit(f"</{tag}>")), F.substring_index(rest, f"</{tag}>", 1))), F.lit(""))


def _blocks(texts: DataFrame, tag: str, children: dict[str, str]) -> DataFrame:
    """A row per closed block of the tag, with its children by their columns' names; blocks without a name go, of equal names in a file the first stays."""
    opened = F.slice(F.split("text", f"<{tag}>"), F.lit(2), F.greatest(F.size(F.split("text", f"<{tag}>")) - 1, F.lit(0)))
    rows = texts.select("file", F.posexplode(opened).alias("pos", "part")).where(F.contains("part", F.lit(f"</{tag}>")))
    block = F.substring_index("part", f"</{tag}>", 1)
    rows = rows.select("file", "pos", *[_child(block, child).alias(column) for column, child in children.items()]).where("name IS NOT NULL")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("file", "name").orderBy("pos"))).where("nth = 1").drop("nth", "pos")


def skills(texts: DataFrame) -> DataFrame:
    """Skills named in prompts: name, description, file of the skill; of equal names the first."""
    return _blocks(texts, "skill", {"name": "name", "description": "description", "skill_file": "file"})


def subagents(texts: DataFrame) -> DataFrame:
    return _blocks(texts, "agent", {"name": "name", "description": "description", "argument_hint": "argumentHint"})


# --- editing states and host logs ---------------------------------------------------------------------------------


def editing_states(files: DataFrame) -> DataFrame:
    """files: file, value. Version, epoch, checkpoints and counts of each editing state; broken JSON gives no row."""
    shape = "struct<version: int, timeline: struct<checkpoints: array<struct<checkpointId: string, epoch: int, requestId: string, label: string, description: string>>, currentEpoch: int, epochCounter: int, operations: array<string>, fileBaselines: array<string>>, fileBaselines: array<string>>"
    rows = files.where(F.try_parse_json("value").isNotNull()).select("file", F.from_json("value", shape).alias("s"))
    t = "s.timeline."
    return rows.where("s IS NOT NULL").select("file", "s.version", F.col(t + "currentEpoch").alias("current_epoch"), F.col(t + "epochCounter").alias("epoch_counter"), F.col(t + "checkpoints").alias("checkpoints"), F.coalesce(F.size(t + "operations"), F.lit(0)).alias("operations"), F.coalesce(F.size(F.coalesce("s.fileBaselines", t + "fileBaselines")), F.lit(0)).alias("file_baselines"))


#: What stands before a version, a token's kind and a delay in a host's log, and what marks its flags.
AGENT_MARK, EDITOR_MARK, SKU_MARK = "Chat:", "VS Code:", "token sku:"
BLOCKER_MARK, DELAY_MARK = "activationBlocker", "for"
MCP_MARK, REFERENCES_MARK, ENABLED_MARK = "MCP server started", "code-referencing", "enabled"


def _after(mark: str, characters: str) -> Column:
    """The characters of this kind that follow the last mark in the line and blanks; null where there are none."""
    rest = F.when(F.col("value").contains(mark), F.ltrim(F.substring_index("value", mark, -1)))
    return F.nullif(F.regexp_extract(rest, f"^[{characters}]+", 0), F.lit(""))


def host_logs(lines: DataFrame) -> DataFrame:
    """lines: file, line_no, value. Per log: the first time, the last versions, token kind and activation delay, and two flags. A line tells versions only if it has both."""
    time = F.concat_ws(" ", F.split_part("value", F.lit(" "), F.lit(1)), F.split_part("value", F.lit(" "), F.lit(2)))
    agent, editor = _after(AGENT_MARK, "0-9."), _after(EDITOR_MARK, "0-9.")
    columns = {
        "time": F.when(F.try_to_timestamp(time).isNotNull() & F.contains(time, F.lit(".")), time),
        "agent": F.when(editor.isNotNull(), agent),
        "editor": F.when(agent.isNotNull(), editor),
        "sku": _after(SKU_MARK, "^ \\t"),
        "blocker": F.when(F.col("value").contains(BLOCKER_MARK) & F.col("value").endswith("ms"), _after(DELAY_MARK, "0-9")),
    }
    rows = lines.withColumns(columns)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("line_no")))
    return rows.groupBy("file").agg(
        F.min_by("time", F.when(F.col("time").isNotNull(), F.col("line_no"))).alias("first_seen"),
        last("agent").alias("agent_version"),
        last("editor").alias("editor_version"),
        last("sku").alias("token_sku"),
        last("blocker").cast("int").alias("activation_blocker_ms"),
        F.bool_or(F.col("value").contains(MCP_MARK)).alias("mcp_server_started"),
        F.bool_or(F.col("value").contains(REFERENCES_MARK) & F.col("value").contains(ENABLED_MARK)).alias("code_referencing_enabled"),
    )
