"""Render and workspace queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import camera, identity, render
from ..sources import testdata as td
from . import oracle as o
from .mining import rounded

PRESETS = ("bottom-creator", "hook-default", "bottom-compact", "center-punch", "unheard-of", "top-clean", "lower-third-clean")


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.expr("cast(substring(clip_id, 6) as int) * 7 + cast(substring(job_id, 5) as int)")
    preset = F.element_at(F.array(*[F.lit(p) for p in PRESETS]), (n % len(PRESETS) + 1).cast("int"))
    return td.clips(spark, sf_dir).withColumns({"n": n, "caption_preset": preset})


def caption_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = render.styled(_clips(spark, sf_dir).select("job_id", "clip_id", "caption_preset"))
    return out.withColumn("header", F.when(F.col("font_size").isNotNull(), F.md5(render.subtitle_header()))).drop("margin_side", "bold")


def render_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _clips(spark, sf_dir).withColumns({"approved": F.col("n") % 3 != 0, "mode": F.when(F.col("n") % 2 == 0, "TRACK").otherwise("GENERAL"), "workspace": F.concat(F.lit("/w's/"), "job_id")})
    sizes = camera.targets(c.select("job_id", "clip_id", F.lit(1920).alias("source_width"), F.lit(1080).alias("source_height")))
    plan = (
        c.join(sizes, ["job_id", "clip_id"])
        .join(F.broadcast(render.outputs(spark)), "aspect_ratio")
        .withColumn("output", render.output_path(F.col("workspace"), F.col("clip_id"), F.col("aspect_ratio")))
        .withColumns({"subtitle": F.replace(F.col("output"), F.lit(".mp4"), F.lit(".ass")), "source_video": F.lit("/v/in.mp4"), "x": F.lit("0"), "y": F.lit("0")})
    )
    return render.commands(plan).select("job_id", "clip_id", "aspect_ratio", F.array_join("argv", " ").alias("argv"))


def render_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports written and read again; even clips' paths are relative."""
    c = _clips(spark, sf_dir).crossJoin(F.broadcast(render.outputs(spark)))  # three rows of sizes
    root = F.concat(F.lit("/w/"), "job_id")
    c = c.withColumn("output", render.output_path(F.when(F.col("n") % 2 == 0, F.lit("out")).otherwise(root), F.col("clip_id"), F.col("aspect_ratio")))
    return render.collected(render.report(c).withColumn("workspace", root)).drop("workspace")


def source_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    hosts = F.array(*[F.lit(h) for h in (*render.FILE_HOSTS, "example.com", "CDN.discordapp.com:443", "cdn.discordapp.com.evil.org")])
    host = F.element_at(hosts, (k % 6 + 1).cast("int"))
    link = F.concat(F.when(k % 5 == 0, "http://").when(k % 5 == 1, "https://").when(k % 5 == 2, "file://").when(k % 5 == 3, "ftp://").otherwise("/home/"), host, F.lit("/a/"), k, F.lit(".mp4"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", render.route(link).alias("route"))


def latest_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    root = F.concat(F.lit("/root"), F.col("o_custkey") % 20)
    path = F.concat(root, F.when(k % 4 == 0, "/jobs/").when(k % 4 == 1, "/skill-jobs/a/jobs/").when(k % 4 == 2, "/jobs/deep/").otherwise("/other/"), k)
    return render.latest_workspace(spark.read.parquet(f"{sf_dir}/orders.parquet").select(root.alias("root"), path.alias("path"), (k * 7919 % 101).alias("mtime_ns")))


def settings_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.col("n_name").alias("key"))
    side = lambda cond, text: n.filter(cond).select("key", F.lit(text).alias("value"))
    env = n.filter("n_nationkey % 3 = 0").select("key", F.when(F.col("n_nationkey") % 6 == 0, "").otherwise("env").alias("value"))
    return render.merged_settings(side("n_nationkey % 2 = 0", "file"), env, side("n_nationkey % 5 <> 4", "default"))


def briefs_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("job-"), "c_custkey").alias("job_id"), F.col("c_custkey").alias("k"), F.col("c_name").alias("theme"))
    request = c.select("job_id", F.lit("v2").alias("rubric_version"))
    response = c.filter("k % 2 = 0").select("job_id", F.when(F.col("k") % 10 == 0, "v1").otherwise("v2").alias("rubric_version"), "theme")
    cache = c.filter("k % 3 = 0").select("job_id", F.when(F.col("k") % 9 == 0, "v1").otherwise("v2").alias("rubric_version"), F.concat(F.lit("old "), "theme").alias("theme"))
    return render.resolved_briefs(request, response, cache)


def scoring_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = td.clips(spark, sf_dir)
    b = c.select("job_id", "clip_id", identity.clip_hash(F.col("start_seconds"), F.col("end_seconds"), F.col("title")).alias("clip_hash"), F.round("score", 2).alias("score"), F.expr("row_number() over (partition by job_id order by score desc, clip_id)").alias("rank"))
    out = render.requests(b, "v1")
    return out.select("job_id", F.get_json_object("request", "$.rubric_version").alias("version"), F.get_json_object("request", "$.clips[0].clip_hash").alias("first_hash"), F.json_array_length(F.get_json_object("request", "$.clips")).alias("n"))


QUERIES = {f.__name__: f for f in (caption_styles, render_commands, render_outputs, source_routes, latest_workspaces, settings_merged, briefs_resolved, scoring_requests)}

_N = "(substr(clip_id, 6)::int * 7 + substr(job_id, 5)::int)"
_PRESET = f"{o.quoted(PRESETS)}[({_N} % {len(PRESETS) + 0} + 1)::int]"
_OUT = "(values " + ", ".join(f"('{r}', {w}, {h})" for r, w, h in render.OUTPUTS) + ") out(aspect_ratio, out_width, out_height)"
_STYLES = "(values " + ", ".join("('" + s[0] + "', " + ", ".join(str(x).lower() for x in s[1:]) + ")" for s in render.STYLES) + ") st(preset, alignment, bold, fr, ff, mr, mf, side, outline, shadow)"
_FMT = "regexp_replace(printf('%.2f', {}::double), '\\.?0+$', '')"
ORACLE = {
    "caption_styles": f"""with c as (select job_id, clip_id, {_PRESET} as caption_preset from {o.CLIPS} x),
        j as (select c.*, out.*, st.* exclude (preset), st.preset as found, greatest(round(out_height * fr)::int, ff) as font_size, greatest(round(out_height * mr)::int, mf) as margin_v
            from c cross join {_OUT} left join {_STYLES} on st.preset = case caption_preset when 'hook-default' then 'bottom-creator' else caption_preset end)
        select job_id, clip_id, caption_preset, alignment, outline::double as outline, shadow::double as shadow, aspect_ratio, out_width, out_height, font_size, margin_v,
            case when found is null then concat('unknown caption preset: ', caption_preset) end as error,
            case when font_size is not null then md5(concat('[Script Info]', chr(10), 'ScriptType: v4.00+', chr(10), 'PlayResX: ', out_width, chr(10), 'PlayResY: ', out_height, {{rest}},
                    concat_ws(',', 'Style: Default', '{render.FONT}', font_size, '&H00FFFFFF&', '&H000000FF&', '&H00000000&', '&H64000000&', case when bold then '-1' else '0' end, '0,0,0,100,100,0,0,1', {_FMT.format('outline')}, {_FMT.format('shadow')}, alignment, side, side, margin_v, '1'), {{events}})) end as header
        from j""".replace("{rest}", "chr(10), 'WrapStyle: 2', chr(10), 'ScaledBorderAndShadow: yes', chr(10), 'YCbCr Matrix: TV.709', chr(10), chr(10), '[V4+ Styles]', chr(10), 'Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding', chr(10)")
    .replace("{events}", "chr(10), chr(10), '[Events]', chr(10), 'Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text', chr(10)"),
    "render_commands": f"""with c as (select *, {_N} as n from {o.CLIPS} x), s as (select 1920 as sw, 1080 as sh),
        t as ({" union all ".join(f"select '{r}' as aspect_ratio, " + "case when {w} * sh >= {h} * sw then sw - sw % 2 else cast(floor(sh * {w} / {h}) as int) - cast(floor(sh * {w} / {h}) as int) % 2 end as tw, case when {w} * sh >= {h} * sw then cast(floor(sw * {h} / {w}) as int) - cast(floor(sw * {h} / {w}) as int) % 2 else sh - sh % 2 end as th from s".format(w=w, h=h) for r, (w, h) in camera.RATIOS.items())}),
        p as (select c.*, t.tw, t.th, out.*, concat('/w''s/', job_id, '/renders/', clip_id, '/', clip_id, '-', replace(out.aspect_ratio, ':', 'x')) as base from c cross join t join {_OUT} on out.aspect_ratio = t.aspect_ratio where n % 3 <> 0),
        q as (select *, concat('ass=filename=''', replace(replace(concat(base, '.ass'), ':', '\\:'), '''', '\\'''), '''') as subs, concat(out_width, ':', out_height) as sz from p)
        select job_id, clip_id, aspect_ratio, concat_ws(' ', 'ffmpeg -hide_banner -loglevel error -y -ss', printf('%.3f', start_seconds), '-to', printf('%.3f', end_seconds), '-i /v/in.mp4',
            case when n % 2 = 0 then concat('-vf crop=', tw, ':', th, ':0:0,scale=', sz, ':flags=lanczos,', subs)
                else concat('-filter_complex [0:v]split=2[bg_src][fg_src];[bg_src]scale=', sz, ':force_original_aspect_ratio=increase:flags=lanczos,crop=', sz, ',boxblur=20:1[bg];[fg_src]scale=', sz, ':force_original_aspect_ratio=decrease:flags=lanczos[fg];[bg][fg]overlay=(W-w)/2:(H-h)/2[composited];[composited]', subs, '[out] -map [out] -map 0:a?') end,
            '{" ".join(render.ENCODE)}', concat(base, '.mp4')) as argv from q""",
    "render_outputs": f"""with c as (select *, {_N} as n from {o.CLIPS} x cross join {_OUT})
        select job_id, clip_id, aspect_ratio, concat('/w/', job_id, case when n % 2 = 0 then '/out' else '' end, '/renders/', clip_id, '/', clip_id, '-', replace(aspect_ratio, ':', 'x'), '.mp4') as path from c""",
    "source_routes": """select c_custkey, case when c_custkey % 5 in (0, 1) then case when c_custkey % 6 in (0, 1, 2, 4) then 'direct' else 'extract' end else 'local' end as route from customer""",
    "latest_workspaces": """with w as (select concat('/root', o_custkey % 20) as root, concat('/root', o_custkey % 20, case o_orderkey % 4 when 0 then '/jobs/' else '/skill-jobs/a/jobs/' end, o_orderkey) as path, o_orderkey * 7919 % 101 as m from orders where o_orderkey % 4 in (0, 1))
        select root, path as workspace from w qualify row_number() over (partition by root order by m desc, path desc) = 1""",
    "settings_merged": """select n_name as key, case when n_nationkey % 3 = 0 and n_nationkey % 6 <> 0 then 'env' when n_nationkey % 2 = 0 then 'file' when n_nationkey % 5 <> 4 then 'default' end as value from nation
        where n_nationkey % 3 = 0 or n_nationkey % 2 = 0 or n_nationkey % 5 <> 4""",
    "briefs_resolved": """select concat('job-', c_custkey) as job_id, 'v2' as rubric_version, case when c_custkey % 10 = 0 then null when c_custkey % 2 = 0 then c_name when c_custkey % 3 = 0 and c_custkey % 9 <> 0 then concat('old ', c_name) end as theme,
        case when c_custkey % 10 = 0 then 'rubric_version does not match' end as error, case when c_custkey % 2 = 0 then 'response' when c_custkey % 3 = 0 and c_custkey % 9 <> 0 then 'cache' end as source from customer""",
    "scoring_requests": f"""with b as (select job_id, clip_id, score, substr(sha1(concat_ws('|', 'v1', printf('%.3f', start_seconds), printf('%.3f', end_seconds), title)), 1, 16) as h from {o.CLIPS} x)
        select job_id, 'v1' as version, arg_min(h, r) as first_hash, count(*)::int as n from (select *, row_number() over (partition by job_id order by score desc, clip_id) as r from b) y group by job_id""",
}
