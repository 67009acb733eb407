"""Tables over collected repositories and extracted tools.

Groups with a null key are left out of the counts by key, while percentages divide by all rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import statistics as st


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)


def count_by(df: DataFrame, key: Column, key_name: str, count_name: str) -> DataFrame:
    """key, count, percentual of all rows."""
    total = df.select(F.count(F.lit(1)).alias("n")).scalar()
    rows = df.select(key.alias(key_name)).where(F.col(key_name).isNotNull()).groupBy(key_name).agg(F.count(F.lit(1)).alias(count_name))
    return rows.withColumn("percentual", _share(F.col(count_name), total))


def filter_and_rank(candidates: DataFrame, languages: list[str], min_stars: int = 100) -> DataFrame:
    """Not a fork, enough stars, a wanted language; sorted by stars (descending), first seen first.

    Ranks over the whole table need its order: the frame is range-sorted, and only top-k callers limit it.
    """
    own = candidates.where((~F.col("is_fork")) & (F.col("stargazer_count") >= min_stars) & F.col("primary_language").isin(*languages))
    return own.orderBy(F.desc("stargazer_count"), "seq")


def collection_funnel(raw: DataFrame, pool: DataFrame, selected: DataFrame) -> DataFrame:
    """etapa, repositorios, percentual_do_bruto of the stages raw, unique, pool, selected."""
    counts = [
        raw.select(F.lit("1_bruto").alias("etapa"), F.lit(1).alias("x")).groupBy("etapa").agg(F.count("x").alias("repositorios")),
        raw.select(F.lit("2_unico").alias("etapa"), "id").groupBy("etapa").agg(F.countDistinct("id").alias("repositorios")),
        pool.select(F.lit("3_elegivel").alias("etapa"), F.lit(1).alias("x")).groupBy("etapa").agg(F.count("x").alias("repositorios")),
        selected.select(F.lit("4_selecionado").alias("etapa"), F.lit(1).alias("x")).groupBy("etapa").agg(F.count("x").alias("repositorios")),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    total = raw.select(F.count(F.lit(1)).alias("n")).scalar()
    return out.withColumn("percentual_do_bruto", F.coalesce(_share(F.col("repositorios"), total), F.lit(0.0)))


def candidates_by_source(raw: DataFrame) -> DataFrame:
    """fonte (the part of a signal before ':'), candidatos, percentual of all candidates."""
    rows = raw.select(F.explode("matched_signals").alias("s")).select(F.split_part("s", F.lit(":"), F.lit(1)).alias("fonte"))
    total = raw.select(F.count(F.lit(1)).alias("n")).scalar()
    return rows.groupBy("fonte").agg(F.count(F.lit(1)).alias("candidatos")).withColumn("percentual", _share(F.col("candidatos"), total))


def tools_per_server(selected: DataFrame, tools: DataFrame) -> DataFrame:
    """Repositories selected and with tools, tools and both means per language, with a 'Total' row (one grouping-sets pass per side)."""
    sel = selected.where("primary_language is not null").groupingSets([[F.col("primary_language")], []], "primary_language").agg(F.countDistinct("name_with_owner").alias("repositorios_selecionados"))
    own = tools.where("repo.primary_language is not null").select(F.col("repo.primary_language").alias("primary_language"), F.col("repo.name_with_owner").alias("r")).groupingSets([[F.col("primary_language")], []], "primary_language").agg(
        F.countDistinct("r").alias("repositorios_com_tools"), F.count(F.lit(1)).alias("tools_total")
    )
    name = lambda df: df.withColumn("linguagem", F.coalesce("primary_language", F.lit("Total"))).drop("primary_language")
    rows = name(sel).join(name(own), "linguagem", "full")
    z = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        "linguagem", z("repositorios_selecionados").alias("repositorios_selecionados"), z("repositorios_com_tools").alias("repositorios_com_tools"), z("tools_total").alias("tools_total"),
        F.try_divide(z("tools_total"), z("repositorios_selecionados")).alias("media_tools_por_repo_selecionado"), F.try_divide(z("tools_total"), z("repositorios_com_tools")).alias("media_tools_por_repo_com_tools"),
    )


def coverage_by_language(selected: DataFrame, tools: DataFrame) -> DataFrame:
    """Selected repositories with and without tools per language."""
    repos = selected.where("primary_language is not null").select("primary_language", "name_with_owner").distinct()
    have = tools.select(F.col("repo.name_with_owner").alias("name_with_owner"), F.lit(True).alias("tem")).where("name_with_owner is not null").distinct()
    rows = repos.join(have, "name_with_owner", "left").groupBy(F.col("primary_language").alias("linguagem")).agg(F.count(F.lit(1)).alias("repositorios_selecionados"), F.count_if("tem").alias("repositorios_com_tools"))
    return rows.withColumn("repositorios_sem_tools", F.col("repositorios_selecionados") - F.col("repositorios_com_tools")).withColumn("taxa_cobertura_percentual", _share(F.col("repositorios_com_tools"), F.col("repositorios_selecionados")))


def call_resolution(nodes: DataFrame) -> DataFrame:
    """categoria, nos, percentual and nodes of levels 2 and 3: each call node (roots left out) is external, ambiguous or resolved."""
    kind = F.when(F.col("ambiguous"), "ambigua").when(F.col("resolved"), "resolvida").otherwise("externa")
    own = nodes.where("depth > 1").select(kind.alias("categoria"), "depth")
    total = own.select(F.count(F.lit(1)).alias("n")).scalar()
    rows = own.groupBy("categoria").agg(F.count(F.lit(1)).alias("nos"), F.count_if(F.col("depth") == 2).alias("nivel_2"), F.count_if(F.col("depth") == 3).alias("nivel_3"))
    return rows.withColumn("percentual", _share(F.col("nos"), total))


def literal_descriptions(tools: DataFrame) -> DataFrame:
    """Literal descriptions per language with a 'Total' row."""
    rows = tools.select(F.col("repo.primary_language").alias("l"), F.coalesce(F.col("tool.description_is_literal"), F.lit(False)).alias("lit")).where("l is not null")
    out = rows.groupingSets([[F.col("l")], []], "l").agg(F.count_if("lit").alias("descricoes_literais"), F.count(F.lit(1)).alias("tools_total"))
    return out.select(F.coalesce("l", F.lit("Total")).alias("linguagem"), "descricoes_literais", "tools_total", _share(F.col("descricoes_literais"), F.col("tools_total")).alias("taxa_literal_percentual"))


def distribution(df: DataFrame, value: Column, name: str) -> DataFrame:
    """estatistica and value: minimum, quartiles, maximum and mean as whole numbers (truncated)."""
    x = df.select(value.cast("double").alias("x")).where("x is not null")
    labels = ["minimo", "p25", "mediana", "p75", "maximo"]
    row = x.agg(F.percentile("x", F.array(*(F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("p"), F.avg("x").alias("media"))
    cells = F.array(*(F.struct(F.lit(n).alias("estatistica"), F.col("p")[i].cast("long").alias(name)) for i, n in enumerate(labels)), F.struct(F.lit("media").alias("estatistica"), F.col("media").cast("long").alias(name)))
    return row.where("p is not null").select(F.explode(cells).alias("c")).select("c.estatistica", f"c.{name}")


def computed_complexity(tools: DataFrame) -> DataFrame:
    """Rows whose complexity was computed: 0 and null mean it was not."""
    return tools.where("tool.cyclomatic_complexity is not null and tool.cyclomatic_complexity > 0")


def loc_complexity_correlation(tools: DataFrame) -> DataFrame:
    """metrica, valor: Pearson, Spearman, Pearson of logarithms, and the share of complexity 1."""
    own = computed_complexity(tools).select(F.col("tool.loc").cast("double").alias("x"), F.col("tool.cyclomatic_complexity").cast("double").alias("y")).where("x > 0")
    one = own.select(F.lit(1).alias("g"), "x", "y")
    rho = st.spearman(one, ["g"], "x", "y", "spearman")
    rest = one.groupBy("g").agg(st.pearson(F.col("x"), F.col("y")).alias("pearson"), st.pearson(F.ln("x"), F.ln("y")).alias("pearson_log"), _share(F.count_if(F.col("y") == 1), F.count(F.lit(1))).alias("pct_cc_1"))
    names = ["pearson", "spearman", "pearson_log", "pct_cc_1"]
    return rest.join(rho, "g").unpivot([], names, "metrica", "valor")


def top_repositories(tools: DataFrame, n: int = 15) -> DataFrame:
    """The n repositories with most tools (a top-k report), with their last known attributes."""
    total = tools.select(F.count(F.lit(1)).alias("n")).scalar()
    rows = tools.where("repo.name_with_owner is not null").groupBy(F.col("repo.name_with_owner").alias("repositorio")).agg(F.count(F.lit(1)).alias("tools"), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("row_id"))).alias(n) for c, n in (("repo.primary_language", "linguagem"), ("repo.stargazer_count", "estrelas"))))
    return rows.orderBy(F.desc("tools"), "repositorio").limit(n).withColumn("percentual_do_total", _share(F.col("tools"), total))


def log_bins(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """faixa (from 1), n: histogram with bins of equal width in the logarithm; the maximum falls into the last bin."""
    x = df.select(F.ln(value.cast("double")).alias("x")).where("x is not null")
    lo, hi = x.select(F.min("x").alias("m")).scalar(), x.select(F.max("x").alias("m")).scalar()
    place = F.when(hi == lo, 1).otherwise(F.least(F.floor((F.col("x") - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins) + 1, F.lit(bins)))
    return x.select(place.cast("int").alias("faixa")).groupBy("faixa").agg(F.count(F.lit(1)).alias("n"))


def stratum_allocation(sizes: DataFrame, n: int) -> DataFrame:
    """Near-equal allocation of n draws to strata (stratum, size): an equal part each, the remainder to the largest.

    One row per stratum, so the window over all of them is as small as the number of strata.
    """
    k = sizes.select(F.count(F.lit(1)).alias("k")).scalar()
    order = F.row_number().over(Window.orderBy(F.desc("size"), "stratum"))
    base = sizes.withColumn("base", F.least(F.floor(F.lit(n) / k), F.col("size"))).withColumn("rk", order)
    left = F.lit(n) - F.floor(F.lit(n) / k) * k
    return base.select("stratum", "size", F.least(F.col("size"), F.col("base") + F.when(F.col("rk") <= left, 1).otherwise(0)).alias("alocado"))


def random_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a hash of the key: a sample that is the same on every run and partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def repos_with_min_tools(tools: DataFrame, least: int) -> DataFrame:
    """Tools of repositories with at least `least` tools (semi join on counts, so no window holds a repository's rows)."""
    full = tools.groupBy(F.col("repo.name_with_owner").alias("r")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return tools.join(full, F.col("repo.name_with_owner") == F.col("r"), "left_semi")


#: Directory names and file name endings that hold no product code.
EXCLUDED_DIRECTORIES = [
    "test", "tests", "__tests__", "spec", "specs", "testing",
    "conformance-test", "conformance-tests",
    "example", "examples", "demo", "demos", "sample", "samples",
    "doc", "docs", "docs_src", "documentation",
    "node_modules", "vendor", "third_party", "dist", "build", "out",
    ".venv", "venv", ".git",
]
EXCLUDED_ENDINGS = [
    ".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx",
    ".test.js", ".spec.js", ".test.jsx", ".spec.jsx",
    ".test.mjs", ".spec.mjs", ".test.cjs", ".spec.cjs",
]


def excluded_by_name(path: Column) -> Column:
    """Whether the file name is one of a test: a fixed ending, or a Python file named test_* or *_test, in any case."""
    name = F.lower(F.substring_index(path, "/", -1))
    ending = F.exists(F.array(*(F.lit(x) for x in EXCLUDED_ENDINGS)), lambda x: F.endswith(name, x))
    # The extension counts as written: only .py in lower case is Python's.
    python = path.endswith(".py") & (name.startswith("test_") | name.endswith("_test.py"))
    return ending | python


def excluded_by_directory(path: Column) -> Column:
    """Whether a directory segment of the path is one of the excluded names, in any case."""
    segments = F.transform(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), F.lower)
    return F.arrays_overlap(segments, F.array(*(F.lit(x) for x in EXCLUDED_DIRECTORIES)))


def source_file_filter(files: DataFrame) -> DataFrame:
    return files.where(~excluded_by_directory(F.col("file_path")) & ~excluded_by_name(F.col("file_path")))


def effective_language(files: DataFrame) -> DataFrame:
    """repo_name, ts, js, linguagem: a repository of JavaScript counts as TypeScript if it has more .ts than .js files."""
    end = F.lower(F.element_at(F.split("file_path", r"\."), -1))
    rows = files.where("repo_name is not null").groupBy("repo_name").agg(F.count_if(end.isin("ts", "tsx")).alias("ts"), F.count_if(end.isin("js", "jsx", "mjs", "cjs")).alias("js"))
    return rows.where("ts + js > 0").withColumn("linguagem", F.when(F.col("ts") > F.col("js"), "TypeScript").otherwise("JavaScript"))


def source_snippets(tools: DataFrame, files: DataFrame) -> DataFrame:
    """row_id, sha256, linhas of the source lines each tool's location points to; a missing file gives null."""
    from ..functions.keys import line_slice

    place = F.col("tool.source_location")
    own = tools.select("row_id", F.col("repo.name_with_owner").alias("repo_name"), place["file"].alias("file_path"), place["start_line"].alias("a"), place["end_line"].alias("b"))
    # A file stored twice counts once: the one with the smallest id.
    text = files.groupBy("repo_name", "file_path").agg(F.min_by("body", "file_id").alias("body"))
    snippet = line_slice(F.col("body"), F.col("a"), F.col("b"))
    return own.join(text, ["repo_name", "file_path"], "left").select("row_id", F.sha2(snippet, 256).alias("sha256"), F.when(snippet.isNotNull(), F.size(F.split(snippet, "\n", -1))).alias("linhas"))


def source_hash_check(evaluations: DataFrame, tools: DataFrame, files: DataFrame) -> DataFrame:
    """scenario, situacao, n: whether an evaluation's source hash is that of the source its tool points to now."""
    hashes = source_snippets(tools, files).join(tools.select("row_id", "tool_uid"), "row_id").groupBy("tool_uid").agg(F.min_by("sha256", F.when(F.col("sha256").isNotNull(), F.col("row_id"))).alias("sha"))
    own = F.col("source_code_sha256")
    state = F.when(own.isNull(), "sem hash").when(F.col("sha").isNull(), "sem fonte").when(F.col("sha") == own, "igual").otherwise("diferente")
    return evaluations.select("tool_uid", "scenario", "source_code_sha256").join(hashes, "tool_uid", "left").groupBy("scenario", state.alias("situacao")).agg(F.count(F.lit(1)).alias("n"))


def below_minimum(tools: DataFrame, least: int) -> DataFrame:
    """repositorio, n_tools of repositories whose sources may go, because they have fewer than `least` tools."""
    return tools.groupBy(F.col("repo.name_with_owner").alias("repositorio")).agg(F.count(F.lit(1)).alias("n_tools")).where(F.col("n_tools") < least)


def retain(sources: DataFrame, tools: DataFrame, least: int) -> DataFrame:
    """Source files without those of such repositories; files of repositories without any tools table stay."""
    return sources.join(below_minimum(tools, least).select(F.col("repositorio").alias("repo_name")), "repo_name", "left_anti")


def pending_extraction(collected: DataFrame, selected: DataFrame, failed: DataFrame, tools: DataFrame) -> DataFrame:
    """Collected repositories that are selected, have not failed and have no tools yet."""
    done = tools.select(F.col("repo.name_with_owner").alias("name_with_owner"))
    rows = collected.join(selected.select("id"), "id", "left_semi").join(failed.select("id"), "id", "left_anti")
    return rows.join(done, "name_with_owner", "left_anti")


def reviewed(articles: DataFrame) -> DataFrame:
    """Articles marked as reviewed; null is not."""
    return articles.where(F.coalesce(F.col("revisado"), F.lit(False)))


def stage_bundle(tables: dict[str, DataFrame | None]) -> dict[str, list[dict] | None]:
    """The report tables of the first stages as plain rows; an absent input stays None."""
    from ..sources.sinks import report_rows

    return {k: None if v is None else report_rows(v) for k, v in tables.items()}
