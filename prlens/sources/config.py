"""Per-repo configuration.

Config files arrive already parsed into rows (the YAML parser itself is not
rebuilt): one row per (repo, file name) with ``parse_ok`` false for a file
that did not parse.  Resolution overlays the defaults one level deep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The default configuration and the config file names in
# precedence order (.yml is read when present; .yaml only otherwise).
DEFAULT_AGENTS = ["correctness", "security", "performance", "maintainability", "dependency", "test", "autofix"]
DEFAULT_SEVERITY = "LOW"
DEFAULT_MAX_LINES = 500
DEFAULT_MAX_FILES = 20
CONFIG_FILES = [".ai-reviewer.yml", ".ai-reviewer.yaml"]


def default_agents_map():
    args = []
    for a in DEFAULT_AGENTS:
        args += [F.lit(a), F.lit(True)]
    return F.create_map(*args)


def resolve_config(repos: DataFrame, overrides: DataFrame) -> DataFrame:
    """Effective config per repo.

    * the first existing file in ``CONFIG_FILES`` order is used, even when it
      does not parse (then the defaults apply);
    * dict-valued keys (``agents``, ``pr_size``) are updated key by key, other
      keys replaced; absent keys keep their default.
    """
    prec = F.lit(len(CONFIG_FILES))
    for i, name in reversed(list(enumerate(CONFIG_FILES))):
        prec = F.when(F.col("file_name") == name, F.lit(i)).otherwise(prec)
    chosen = (
        overrides.filter(F.col("file_name").isin(CONFIG_FILES))
        .groupBy("repo_name")
        .agg(F.min_by(F.struct("file_name", "parse_ok", "agents", "severity_threshold", "ignore", "pr_size"),
                      prec).alias("c"))
    )
    j = repos.select("repo_name").join(chosen, "repo_name", "left")
    use = F.coalesce(F.col("c.parse_ok"), F.lit(False))
    agents = F.when(use & F.col("c.agents").isNotNull(), F.map_concat(default_agents_map(), F.col("c.agents"))) \
        .otherwise(default_agents_map())
    sev = F.when(use, F.coalesce(F.col("c.severity_threshold"), F.lit(DEFAULT_SEVERITY))).otherwise(F.lit(DEFAULT_SEVERITY))
    ignore = F.when(use, F.coalesce(F.col("c.ignore"), F.array().cast("array<string>"))) \
        .otherwise(F.array().cast("array<string>"))
    max_lines = F.when(use, F.coalesce(F.try_element_at(F.col("c.pr_size"), F.lit("max_lines")), F.lit(DEFAULT_MAX_LINES))) \
        .otherwise(F.lit(DEFAULT_MAX_LINES))
    max_files = F.when(use, F.coalesce(F.try_element_at(F.col("c.pr_size"), F.lit("max_files")), F.lit(DEFAULT_MAX_FILES))) \
        .otherwise(F.lit(DEFAULT_MAX_FILES))
    return j.select(
        "repo_name",
        F.col("c.file_name").alias("config_file"),
        agents.alias("agents"),
        sev.alias("severity_threshold"),
        ignore.alias("ignore"),
        max_lines.cast("bigint").alias("max_lines"),
        max_files.cast("bigint").alias("max_files"),
    )
