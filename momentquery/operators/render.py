"""Render plans: styles, paths, commands and reports. Nothing is encoded here; commands are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Preset, alignment, bold, font ratio and floor, vertical margin ratio and floor, side margins, outline, shadow.
STYLES = (
    ("bottom-creator", 2, True, 0.05, 32, 0.12, 80, 60, 3.0, 2.0),
    ("bottom-compact", 2, True, 0.04, 28, 0.10, 64, 72, 2.5, 1.5),
    ("lower-third-clean", 2, False, 0.045, 30, 0.22, 140, 80, 2.0, 1.0),
    ("center-punch", 5, True, 0.075, 48, 0.0, 0, 48, 4.0, 3.0),
    ("top-clean", 8, False, 0.045, 30, 0.10, 64, 80, 2.0, 1.0),
)
STYLE = "preset string, alignment int, bold boolean, font_ratio double, font_floor int, margin_ratio double, margin_floor int, margin_side int, outline double, shadow double"
ALIASES = {"hook-default": "bottom-creator"}
# Sizes of the outputs, the font, blur, and hosts whose links are files themselves.
OUTPUTS = (("9:16", 1080, 1920), ("1:1", 1080, 1080), ("16:9", 1920, 1080))
FONT = "Helvetica Neue"
BLUR = "20:1"
FILE_HOSTS = ("cdn.discordapp.com", "media.discordapp.net", "api.telegram.org")
ENCODE = ("-c:v", "libx264", "-preset", "medium", "-crf", "18", "-pix_fmt", "yuv420p", "-movflags", "+faststart", "-c:a", "aac", "-b:a", "192k", "-ac", "2")


def styles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STYLES, STYLE)


def outputs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OUTPUTS, "aspect_ratio string, out_width int, out_height int")


def styled(clips: DataFrame, preset: str = "caption_preset") -> DataFrame:
    """clips with their caption style for each output: font_size and margin_v in its pixels. Unknown presets have
    the error set. The style and size tables are constants of five and three rows."""
    spark = clips.sparkSession
    aliases = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    named = F.coalesce(F.try_element_at(aliases, F.col(preset)), F.col(preset))
    found = clips.withColumn("_preset", named).join(F.broadcast(styles(spark)), F.col("_preset") == F.col("preset"), "left").crossJoin(F.broadcast(outputs(spark)))
    size = lambda ratio, floor: F.greatest(F.round(F.col("out_height") * F.col(ratio)).cast("int"), F.col(floor))
    return found.withColumns(
        {"font_size": size("font_ratio", "font_floor"), "margin_v": size("margin_ratio", "margin_floor"), "error": F.when(F.col("preset").isNull(), F.concat(F.lit("unknown caption preset: "), F.col(preset)))}
    ).drop("_preset", "preset", "font_ratio", "font_floor", "margin_ratio", "margin_floor")


def output_path(workspace: Column, clip_id: Column, ratio: Column) -> Column:
    return F.concat(workspace, F.lit("/renders/"), clip_id, F.lit("/"), clip_id, F.lit("-"), F.replace(ratio, F.lit(":"), F.lit("x")), F.lit(".mp4"))


def filter_path(path: Column) -> Column:
    """A path inside a filter argument."""
    out = path
    for plain, escaped in (("\\", "\\\\"), (":", "\\:"), ("'", "\\'")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(F.format_string("%.2f", x), r"\.?0+$", "")


def subtitle_header() -> Column:
    """The head of a subtitle file from the columns of styled()."""
    style = F.concat_ws(
        ",",
        F.lit("Style: Default"), F.lit(FONT), F.col("font_size"), F.lit("&H00FFFFFF&"), F.lit("&H000000FF&"), F.lit("&H00000000&"), F.lit("&H64000000&"),
        F.when(F.col("bold"), "-1").otherwise("0"), F.lit("0,0,0,100,100,0,0,1"), _trimmed(F.col("outline")), _trimmed(F.col("shadow")), F.col("alignment"), F.col("margin_side"), F.col("margin_side"), F.col("margin_v"), F.lit("1"),
    )
    return F.concat(
        F.lit("[Script Info]\nScriptType: v4.00+\nPlayResX: "), F.col("out_width"), F.lit("\nPlayResY: "), F.col("out_height"),
        F.lit("\nWrapStyle: 2\nScaledBorderAndShadow: yes\nYCbCr Matrix: TV.709\n\n[V4+ Styles]\nFormat: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding\n"),
        style, F.lit("\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"),
    )


def commands(plan: DataFrame, binary: str = "ffmpeg") -> DataFrame:
    """plan(approved, mode, source_video, start_seconds, end_seconds, target_width, target_height, x, y, out_width,
    out_height, subtitle, output) with argv, one encode a row; clips that aren't approved have none."""
    size = F.concat_ws(":", "out_width", "out_height")
    subtitles = F.concat(F.lit("ass=filename='"), filter_path(F.col("subtitle")), F.lit("'"))
    track = F.concat(F.lit("crop="), F.concat_ws(":", "target_width", "target_height", "x", "y"), F.lit(",scale="), size, F.lit(":flags=lanczos,"), subtitles)
    general = F.concat(
        F.lit("[0:v]split=2[bg_src][fg_src];[bg_src]scale="), size, F.lit(":force_original_aspect_ratio=increase:flags=lanczos,crop="), size,
        F.lit(f",boxblur={BLUR}[bg];[fg_src]scale="), size, F.lit(":force_original_aspect_ratio=decrease:flags=lanczos[fg];[bg][fg]overlay=(W-w)/2:(H-h)/2[composited];[composited]"), subtitles, F.lit("[out]"),
    )
    start = F.array(F.lit(binary), *[F.lit(x) for x in ("-hide_banner", "-loglevel", "error", "-y", "-ss")], F.format_string("%.3f", "start_seconds"), F.lit("-to"), F.format_string("%.3f", "end_seconds"), F.lit("-i"), F.col("source_video"))
    video = F.when(F.col("mode") == "GENERAL", F.array(F.lit("-filter_complex"), general, F.lit("-map"), F.lit("[out]"), F.lit("-map"), F.lit("0:a?"))).otherwise(F.array(F.lit("-vf"), track))
    return plan.filter("approved").withColumn("argv", F.concat(start, video, F.array(*[F.lit(x) for x in ENCODE]), F.array(F.col("output"))))


def report(rendered: DataFrame) -> DataFrame:
    """job_id, clip_id and outputs, a JSON object from ratio to path."""
    entries = F.array_sort(F.collect_list(F.struct("aspect_ratio", "output")))
    return rendered.groupBy("job_id", "clip_id").agg(F.to_json(F.map_from_entries(entries)).alias("outputs"))


def collected(reports: DataFrame, workspace: str = "workspace") -> DataFrame:
    """Reports as a row for each path; relative ones are below the workspace."""
    each = reports.select("job_id", "clip_id", workspace, F.explode(F.from_json("outputs", "map<string,string>")).alias("aspect_ratio", "path"))
    full = F.when(F.startswith("path", F.lit("/")), F.col("path")).otherwise(F.concat(F.col(workspace), F.lit("/"), F.col("path")))
    return each.withColumn("path", full)


def route(source: Column) -> Column:
    """direct: a link to a file on a known host; extract: any other web link; local: a path or file link."""
    scheme, host = F.lower(F.regexp_extract(source, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lower(F.regexp_extract(source, r"^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]*)", 1))
    return F.when(scheme.isin("http", "https"), F.when(host.isin(*FILE_HOSTS), "direct").otherwise("extract")).otherwise("local")


def latest_workspace(listing: DataFrame) -> DataFrame:
    """listing(root, path, mtime_ns): each root's newest workspace, of equals the last by path. Workspaces are folders
    at jobs/* and skill-jobs/*/jobs/*."""
    below = F.substring("path", F.length("root") + 2, F.length("path"))
    return listing.filter(F.rlike(below, F.lit("^(jobs/[^/]+|skill-jobs/[^/]+/jobs/[^/]+)$"))).groupBy("root").agg(F.max_by("path", F.struct("mtime_ns", "path")).alias("workspace"))


def merged_settings(file: DataFrame, environment: DataFrame, defaults: DataFrame) -> DataFrame:
    """key, value: the environment's where it isn't empty, else the file's, else the default's."""
    f, e, d = (df.select("key", F.col("value").alias(n)) for df, n in ((file, "f"), (environment, "e"), (defaults, "d")))
    joined = f.join(e, "key", "full_outer").join(d, "key", "full_outer")
    return joined.select("key", F.coalesce(F.nullif("e", F.lit("")), "f", "d").alias("value"))


def resolved_briefs(requests: DataFrame, responses: DataFrame, cache: DataFrame) -> DataFrame:
    """For each request (job_id, rubric_version): the response's theme, else the cache's of that version; a response
    of another version has the error set."""
    r = responses.select("job_id", F.col("rubric_version").alias("r_version"), F.col("theme").alias("r_theme"))
    c = cache.select("job_id", "rubric_version", F.col("theme").alias("c_theme"))
    both = requests.join(r, "job_id", "left").join(c, ["job_id", "rubric_version"], "left")
    wrong = F.col("r_version").isNotNull() & (F.col("r_version") != F.col("rubric_version"))
    return both.select(
        "job_id", "rubric_version", F.when(~wrong, F.coalesce("r_theme", "c_theme")).otherwise(F.lit(None)).alias("theme"),
        F.when(wrong, "rubric_version does not match").alias("error"),
        F.when(F.col("r_theme").isNotNull(), "response").when(F.col("c_theme").isNotNull(), "cache").alias("source"),
    )


def requests(briefs: DataFrame, version: str) -> DataFrame:
    """job_id and request, one JSON document with the job's briefs in order of rank; jobs without briefs have none."""
    rows = briefs.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("rank", "clip_id", "clip_hash", "score"))).alias("clips"))
    return rows.select("job_id", F.to_json(F.struct(F.lit(version).alias("rubric_version"), "job_id", "clips")).alias("request"))


def manifests(clips: DataFrame, outputs: DataFrame, crops: DataFrame, lines: DataFrame) -> DataFrame:
    """One render manifest a clip: clips(job_id, clip_id, approved, source_video, start_seconds, end_seconds, mode,
    caption_preset) with outputs and crop_plans, maps by ratio, and caption_plan, the lines in order.

    outputs: job_id, clip_id, aspect_ratio, output. crops: job_id, clip_id, aspect_ratio, plan. lines: job_id, clip_id,
    line_idx, line. Keys of a map are in order, so equal manifests are equal documents."""
    key = ["job_id", "clip_id"]
    by_ratio = lambda rows, value, name: rows.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("aspect_ratio", value)))).alias(name))
    said = lines.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("line_idx", "line"))), lambda x: x["line"]).alias("caption_plan"))
    out = clips.join(by_ratio(outputs, "output", "outputs"), key, "left").join(by_ratio(crops, "plan", "crop_plans"), key, "left").join(said, key, "left")
    line = lines.schema["line"].dataType.simpleString()
    return out.withColumn("caption_plan", F.coalesce("caption_plan", F.array().cast(f"array<{line}>")))
