"""Queries over sources and dataset assembly."""
from __future__ import annotations

from pyspark.sql import functions as F

from pixelwarrant import fixtures as fx
from pixelwarrant.operators import dataset as ds
from pixelwarrant.operators import ranks, severities, training_log
from pixelwarrant.plans.registry import cte, query
from pixelwarrant.plans.rounding import rounded
from pixelwarrant.sources import files, images, tables

# --- paths: one file name per labelled item, with mixed-case folders and foreign suffixes ---

SUFFIX_BY_REST = (".jpg", ".PNG", ".txt", ".jpeg", ".webp", ".bmp", ".JPG")
cte(
    "paths",
    """select id, y, '/lake/'||family||'/'||case when id%5=0 then upper(d) else d end||'/'||id||s as path from
  (select *, case y when 1 then 'fake' else 'real' end as d, (['.jpg','.PNG','.txt','.jpeg','.webp','.bmp','.JPG'])[(id%7+1)::int] as s from arms)""",
    ("arms",),
)


def paths(spark, sf):
    side = F.when(F.col("y") == 1, "fake").otherwise("real")
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIX_BY_REST]), (F.col("id") % 7 + 1).cast("int"))
    return fx.arms(spark, sf).select(
        "id",
        "y",
        F.concat(
            F.lit("/lake/"),
            "family",
            F.lit("/"),
            F.when(F.col("id") % 5 == 0, F.upper(side)).otherwise(side),
            F.lit("/"),
            F.col("id").cast("string"),
            suffix,
        ).alias("path"),
    )


IMG = "regexp_matches(lower(path),'[.](jpg|jpeg|png|webp|bmp)$')"


def written_paths(spark, sf, name):
    """A folder that holds a file at every one of `paths`."""
    root = tables.scratch_dir(spark, name)
    files.write_files(paths(spark, sf).select("path", F.encode(F.col("id").cast("string"), "utf-8").alias("content")), root)
    return root


def below(root):
    """The part of a listed path below the folder it was listed from."""
    return F.regexp_extract("path", "/" + root.rstrip("/").rsplit("/", 1)[-1] + "(/.*)$", 1)


@query("src01_image_listing", ("paths",), f"select path, strlen(id::varchar)::bigint as length from paths where {IMG}")
def image_listing(spark, sf):
    """Files of a written lake, found by listing it."""
    root = written_paths(spark, sf, "lake")
    return images.list_images(spark, root).select(below(root).alias("path"), "length")


@query(
    "src02_labelled_roots",
    ("paths",),
    f"select path, split_part(path,'/',3) as dataset, (split_part(path,'/',4)='fake')::int as label from paths where {IMG} and split_part(path,'/',4) in ('real','fake')",
)
def labelled_roots(spark, sf):
    listed = paths(spark, sf).where(images.is_image(F.col("path"))).select("path")
    return images.label_by_folder(listed)


@query(
    "src03_unlabelled_folder",
    ("paths",),
    f"select split_part(path,'/',3) as folder, count(*) as n from paths where {IMG} group by 1",
)
def unlabelled_folder(spark, sf):
    root = written_paths(spark, sf, "scored")
    listed = images.unlabelled_folder(spark, root).select(below(root).alias("path"))
    return listed.groupBy(F.element_at(F.split("path", "/"), 3).alias("folder")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "src02_page_language_roots",
    (),
    """select split_part(split_part(url,'//',2),'/',1) as dataset, sum((s='en')::int)::bigint as real, sum((s<>'en')::int)::bigint as fake from
  (select url, regexp_extract(url,'/(en|fr)/',1) as s from pages) where s<>'' group by 1""",
)
def page_language_roots(spark, sf):
    pages = fx.table(spark, sf, "pages").select(F.col("url").alias("path"))
    labelled = images.label_by_folder(pages, real="en", fake="fr")
    return labelled.groupBy("dataset").agg(
        F.sum(1 - F.col("label")).alias("real"), F.sum("label").cast("long").alias("fake")
    )


def image_rows(spark, sf):
    """Three-channel image rows made from the vectors; every tenth one is cut short."""
    level = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 0.5) * 255).cast("int")))
    text = F.array_join(F.transform("embedding", lambda v: F.repeat(F.lpad(F.hex(level(v)), 2, "0"), 3)), "")
    whole = F.unhex(text)
    return fx.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("image_id"),
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.lit(3).alias("nChannels"),
        F.when(F.col("vec_id") % 10 == 0, F.substring(whole, 1, 100)).otherwise(whole).alias("data"),
    )


@query(
    "src04_decode_and_count_errors",
    ("tiles",),
    """select image_id, image_id%10<>0 as decoded, case when image_id%10<>0 then count(*) end as cells,
  case when image_id%10<>0 then round(sum((greatest(0,least(255,floor((v+5e-1)*255))))),6) end as total_r from tiles group by image_id""",
)
def decode(spark, sf):
    """Pictures written as PNG files and read back by the image source; a cut-off one is a file that doesn't decode."""
    root = tables.scratch_dir(spark, "pictures")
    named = image_rows(spark, sf).withColumn("path", F.concat(F.col("image_id").cast("string"), F.lit(".png")))
    files.write_images(named, root)
    number = F.regexp_extract("path", r"/(\d+)\.png$", 1).cast("long").alias("image_id")
    pictures = images.read_images(spark, root, invalid=True).select(number, "height", "width", "nChannels", "data")
    decoded = F.count("x") > 0
    each = images.image_cells(pictures).groupBy("image_id").agg(decoded.alias("decoded"), F.count("x").alias("cells"), F.round(F.sum("r"), 6).alias("total_r"))
    return each.select("image_id", "decoded", F.when(F.col("decoded"), F.col("cells")).alias("cells"), "total_r")


@query("src05_payload_scan", (), "select md5(text) as digest, strlen(text)::int as n_bytes from documents")
def payload_scan(spark, sf):
    rows = tables.read_payloads(spark, f"{sf}/documents.parquet", "text")
    return rows.select(F.md5("payload").alias("digest"), F.octet_length("payload").alias("n_bytes"))


@query(
    "src06_shard_offset",
    (),
    "select doc_id, case when doc_id%4>=2 then 'second' else 'first' end as family from documents",
)
def shard_offset(spark, sf):
    """Two families read disjoint ranges of one corpus' sorted shard files."""
    path = tables.scratch_dir(spark, "shards")
    docs = fx.table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 4).alias("shard"))
    docs.repartition("shard").write.partitionBy("shard").parquet(path)
    files = spark.read.parquet(path).inputFiles()
    second = set(tables.shard_slice(files, len(files) // 2))
    read = lambda names: spark.read.parquet(*sorted(names)).select("doc_id")
    first, later = read(set(files) - second), read(second)
    assert tables.shared_files(first, later).isEmpty()
    return first.withColumn("family", F.lit("first")).unionByName(later.withColumn("family", F.lit("second")))


@query(
    "src07_three_class_scan",
    ("patches",),
    """select class||'_'||image_id||'_'||patch_no as stem, class, case class when 'real' then 0 when 'synthetic' then 1 else 2 end as label,
  case when class='tampered' then 'masks/'||class||'_'||image_id||'_'||patch_no||'.png' end as mask from
  (select *, row_number() over (partition by class order by image_id, patch_no) as r from patches) where r<=3000""",
)
def three_class_scan(spark, sf):
    capped = ds.per_class_cap(fx.patches(spark, sf), "class", ["image_id", "patch_no"], 3000)
    stem = F.concat_ws("_", "class", F.col("image_id").cast("string"), F.col("patch_no").cast("string"))
    return capped.select(
        stem.alias("stem"),
        "class",
        F.when(F.col("class") == "real", 0).when(F.col("class") == "synthetic", 1).otherwise(2).alias("label"),
        F.when(F.col("class") == "tampered", F.concat(F.lit("masks/"), stem, F.lit(".png"))).alias("mask"),
    )


@query(
    "src08_archive_scan",
    (),
    """select doc_id//50 as archive, lang as category, lang||'/'||case when n_chars%2=0 then '1_fake' else '0_real' end||'/'||doc_id||'.PNG' as member, (n_chars%2=0)::int as label, md5(text) as payload
  from documents where doc_id%7<>0""",
)
def archive_scan(spark, sf):
    """Fifty documents to an archive, every seventh one in a folder of neither class; each archive is read in several byte ranges."""
    side = F.when(F.col("doc_id") % 7 == 0, "notes").when(F.col("n_chars") % 2 == 0, images.ARCHIVE_FAKE).otherwise(images.ARCHIVE_REAL)
    docs = fx.table(spark, sf, "documents").select(
        F.expr("doc_id div 50").alias("archive"),
        F.concat_ws("/", "lang", side, F.concat(F.col("doc_id").cast("string"), F.lit(".PNG"))).alias("member"),
        F.col("text").alias("content"),
    )
    root = tables.scratch_dir(spark, "archives")
    files.write_archives(docs, root)
    members = images.archive_members(spark, root, range_bytes=str(16 << 10))
    return members.select(
        F.regexp_extract("archive", r"/(\d+)\.zip$", 1).cast("long").alias("archive"), "category", "member", "label", F.md5("content").alias("payload")
    )


@query(
    "src09_relabel_layout",
    ("paths",),
    "select path, lower(split_part(path,'/',4)) as side, lower(split_part(path,'/',4))||'/train_'||split_part(path,'/',5) as dest from paths",
)
def relabel_layout(spark, sf):
    return images.relabel_layout(paths(spark, sf).select("path"), "train").select("path", "side", "dest")


@query(
    "src10_demo_never_trains",
    (),
    "select 'exact_text' as check, (select count(*) from benchmark b where exists (select 1 from documents d where d.text=b.text)) as leaked, (select count(*) from benchmark) as held_out",
)
def demo_guard(spark, sf):
    demo = fx.table(spark, sf, "benchmark").select(F.xxhash64("text").alias("k"), F.col("text").alias("t"))
    train = fx.table(spark, sf, "documents").select(F.xxhash64("text").alias("k"), F.col("text").alias("t"))
    found = demo.join(train, ["k", "t"], "left_semi").agg(F.count(F.lit(1)).alias("leaked"))
    total = demo.agg(F.count(F.lit(1)).alias("held_out"))
    return found.select(F.lit("exact_text").alias("check"), "leaked", total.scalar().alias("held_out"))


FEATURE_BLOCKS = [("semantic", 32), ("spectral", 32)]


@query(
    "src11_feature_cache_write",
    ("feat",),
    "select family, count(*) as n, min(len(features))::int as dim, sum(is_aug::int)::bigint as copies from feat group by family",
)
def feature_cache_write(spark, sf):
    path = tables.scratch_dir(spark, "features")
    tables.write_features(fx.feat(spark, sf), path, FEATURE_BLOCKS, "v1")
    stored = tables.read_features(spark, path)
    return stored.groupBy(F.col("family").cast("int").alias("family")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.size("features")).alias("dim"),
        F.sum(F.col("is_aug").cast("long")).alias("copies"),
    )


@query(
    "src12_feature_cache_read",
    ("feat",),
    "select sample_id, group_id, y, is_aug, round(features[1]::double,6) as first, round(features[64]::double,6) as last, family from feat",
)
def feature_cache_read(spark, sf):
    path = tables.scratch_dir(spark, "features")
    tables.write_features(fx.feat(spark, sf), path, FEATURE_BLOCKS, "v1")
    rows = tables.read_features(spark, path)
    return rounded(
        rows.select(
            "sample_id",
            "group_id",
            "y",
            "is_aug",
            F.col("features")[0].cast("double").alias("first"),
            F.col("features")[63].cast("double").alias("last"),
            "family",
        )
    )


@query(
    "src13_predictions",
    ("paths",),
    "select path as image_path, round(p_with,6) as pred, (p_with>=5e-1)::int as label from paths join (select id, p_with from arms) using (id)",
)
def predictions(spark, sf):
    """The predictions file, written and read back."""
    scored = paths(spark, sf).join(fx.arms(spark, sf).select("id", "p_with"), "id")
    rows = tables.predictions(scored, F.col("path"), F.col("p_with"), F.lit(0.5))
    out = tables.scratch_dir(spark, "predictions")
    tables.write_json(rows, out)
    return rounded(spark.read.schema("image_path string, pred double, label int").json(out))


@query(
    "src15_provenance_manifest",
    (),
    """select case when n_chars%2=0 then 'fake' else 'real' end||'/'||source||'_'||lang||'_'||printf('%06d',doc_id)||'.jpg' as dest, case when n_chars%2=0 then 'fake' else 'real' end as label,
  'hub/'||source as source_repo, lang as source_file, doc_id as row_index, (64+n_chars%1000)::int as orig_width, (64+(n_chars*37)%800)::int as orig_height,
  (['PNG','JPEG','WEBP'])[(doc_id%3+1)::int] as orig_format, 256 as crop_size, 'JPEG' as stored_format, 95 as jpeg_quality from documents where least(64+n_chars%1000,64+(n_chars*37)%800)>=256""",
)
def provenance_manifest(spark, sf):
    docs = sized_documents(spark, sf)
    kept = ds.native_crop(docs, 256, "orig_width", "orig_height")
    repo = F.concat(F.lit("hub/"), "source")
    rows = kept.select(
        F.concat("side", F.lit("/"), ds.traceable_stem(repo, F.col("lang"), F.col("doc_id")), F.lit(".jpg")).alias("dest"),
        F.col("side").alias("label"),
        repo.alias("source_repo"),
        F.col("lang").alias("source_file"),
        F.col("doc_id").alias("row_index"),
        "orig_width",
        "orig_height",
        F.element_at(F.array(F.lit("PNG"), F.lit("JPEG"), F.lit("WEBP")), (F.col("doc_id") % 3 + 1).cast("int")).alias("orig_format"),
        F.lit(256).alias("crop_size"),
        F.lit("JPEG").alias("stored_format"),
        F.lit(95).alias("jpeg_quality"),
    ).select(*ds.MANIFEST_COLUMNS)
    # Two runs share a part of their rows, and the second one is repeated as after a lost commit: each row is there once.
    out = tables.scratch_dir(spark, "manifest")
    tables.append_once(rows.where(F.col("row_index") % 3 < 2), out, "first", "dest")
    for _ in range(2):
        tables.append_once(rows.where(F.col("row_index") % 3 > 0), out, "second", "dest")
    return tables.read_manifest(spark, out).select(*ds.MANIFEST_COLUMNS)


def sized_documents(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.select(
        "*",
        F.when(F.col("n_chars") % 2 == 0, "fake").otherwise("real").alias("side"),
        (64 + F.col("n_chars") % 1000).cast("int").alias("orig_width"),
        (64 + (F.col("n_chars") * 37) % 800).cast("int").alias("orig_height"),
    )


@query(
    "src16_manifest_accumulation",
    (),
    """select class, count(*) as n, list_sort(list(distinct shard)) as shards, sum((mask is not null)::int)::bigint as with_masks from
  (select source||'_'||doc_id as stem, source as class, 0 as shard, case when doc_id%3=0 then 'm' end as mask from documents where doc_id%4<3
   union all select source||'_'||doc_id, source, 1, case when doc_id%3=0 then 'm' end from documents where doc_id%4=3) group by class""",
)
def manifest_accumulation(spark, sf):
    docs = fx.table(spark, sf, "documents").select(
        F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("stem"),
        F.col("source").alias("class"),
        F.when(F.col("doc_id") % 3 == 0, "m").alias("mask"),
        "doc_id",
    )
    first = docs.where(F.col("doc_id") % 4 < 3).withColumn("shard", F.lit(0))
    second = docs.where(F.col("doc_id") % 4 >= 2).withColumn("shard", F.lit(1))
    out = tables.scratch_dir(spark, "shards")
    for run, shard in (("0", first), ("1", second), ("1", second)):
        tables.append_once(shard.drop("doc_id"), out, run)
    read = tables.read_manifest(spark, out)
    merged = ds.accumulate_manifest(read.where("shard = 0"), read.where("shard = 1"))
    return merged.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"),
        F.sort_array(F.collect_set("shard")).alias("shards"),
        F.count_if(F.col("mask").isNotNull()).alias("with_masks"),
    )


@query(
    "src17_metric_matrix_rows",
    ("arms",),
    "select lang, count(*) as n, round(avg(p_with),6) as mean_with, round(avg(p_without),6) as mean_without from arms group by lang",
)
def metric_matrix_rows(spark, sf):
    path = tables.scratch_dir(spark, "matrix")
    matrix = rounded(
        fx.arms(spark, sf)
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("p_with").alias("mean_with"), F.avg("p_without").alias("mean_without"))
    )
    tables.write_csv_matrix(matrix, path)
    return spark.read.option("header", "true").schema(matrix.schema).csv(path)


EPOCH_SQL = "select user_id as run, event_id, row_number() over (partition by user_id order by event_id) as epoch, value/5e2 as val, (hash_k%100)/1e2 as auc from (select *, event_id*7919+user_id as hash_k from events)"
cte("epochs", EPOCH_SQL)


def epochs(spark, sf):
    """An epoch log: the user is the run, events in order are its epochs."""
    return fx.table(spark, sf, "events").select(
        F.col("user_id").alias("run"),
        "event_id",
        (F.col("value") / 500.0).alias("val"),
        ((F.col("event_id") * 7919 + F.col("user_id")) % 100 / F.lit(100.0)).alias("auc"),
    )


@query("src18_epoch_log", ("epochs",), "select run, epoch, round(val,6) as val, round(auc,6) as auc from epochs")
def epoch_log(spark, sf):
    """The log as lines of JSON, written and read back."""
    numbered = ranks.positions(epochs(spark, sf), ["run"], ["event_id"], "epoch")
    lines = numbered.select(F.col("run").cast("string").alias("run"), F.col("epoch").cast("int").alias("epoch"), F.col("val").alias("val_pred_std"), F.col("auc").alias("val_auc"))
    out = tables.scratch_dir(spark, "log")
    tables.write_json(lines, out)
    log = tables.read_log(spark, out)
    return rounded(log.select(F.col("run").cast("long").alias("run"), F.col("epoch").cast("long").alias("epoch"), F.col("val_pred_std").alias("val"), F.col("val_auc").alias("auc")))


@query(
    "src20_resume_log",
    (),
    "select doc_id from documents where doc_id not in (select doc_id from labels)",
)
def resume_log(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id")
    return ds.not_recorded(docs, fx.table(spark, sf, "labels").select("doc_id"), "doc_id")


# --- gates and crops ----------------------------------------------------------------------


def labelled_documents(spark, sf):
    arms = fx.arms(spark, sf)
    return arms.select(F.col("family").alias("dataset"), F.col("y").alias("label"), "id")


@query(
    "prj01_dataset_quality_gate",
    ("arms",),
    """select r.dataset, coalesce(a.real,0)::bigint as real, coalesce(a.fake,0)::bigint as fake, case when r.miss then 'missing' when coalesce(a.real,0)=0 and coalesce(a.fake,0)=0 then 'empty'
   when coalesce(a.real,0)=0 or coalesce(a.fake,0)=0 then 'one-sided' end as problem from
  (select distinct source as dataset, false as miss from documents union all select distinct source||'_absent', true from documents where source='src1') r
  left join (select family, sum((y=0)::int) as real, sum((y=1)::int) as fake from arms where not (family='src2') and not (family='src3' and y=1) group by family) a on a.family=r.dataset""",
)
def quality_gate(spark, sf):
    known = fx.table(spark, sf, "documents").select(F.col("source").alias("dataset")).distinct()
    absent = known.where(F.col("dataset") == "src1").select(F.concat("dataset", F.lit("_absent")).alias("dataset"))
    samples = labelled_documents(spark, sf).where(
        (F.col("dataset") != "src2") & ~((F.col("dataset") == "src3") & (F.col("label") == 1))
    )
    return ds.root_problems(known.unionByName(absent), samples, known)


def sizes(spark, sf):
    return fx.patches(spark, sf)


CROP = "((({a}-{s})::int)>>1) & ~7"


@query(
    "prj02_native_crop",
    ("patches",),
    f"select image_id, patch_no, w, h, ((w-256)::int>>1) & ~7 as left, ((h-256)::int>>1) & ~7 as top from patches where least(w,h)>=256",
)
def native_crop(spark, sf):
    return ds.native_crop(sizes(spark, sf), 256).select("image_id", "patch_no", "w", "h", "left", "top")


@query(
    "prj03_canonical_crop",
    ("patches",),
    """select image_id, patch_no, rw as resized_w, rh as resized_h, ((rw-256)>>1) & ~7 as left, ((rh-256)>>1) & ~7 as top from
  (select *, case when least(w,h)<256 then greatest(256,round_even(w*(256e0/least(w,h)),0)::int) else w::int end as rw,
   case when least(w,h)<256 then greatest(256,round_even(h*(256e0/least(w,h)),0)::int) else h::int end as rh from patches)""",
)
def canonical_crop(spark, sf):
    return ds.canonical_crop(sizes(spark, sf), 256).select("image_id", "patch_no", "resized_w", "resized_h", "left", "top")


@query(
    "prj04_skip_accounting",
    ("patches",),
    """select class, count(*) filter (s='written') as written, count(*) filter (s='small') as small, count(*) filter (s='error') as error from
  (select class, case when image_id%13=0 then 'error' when least(w,h)<256 then 'small' else 'written' end as s from patches) group by class""",
)
def skip_accounting(spark, sf):
    return ds.skip_accounting(sizes(spark, sf), 256, "class", F.col("image_id") % 13 != 0)


SEV_VALUES = ", ".join(
    f"('{name}',{i},'{op}',{param}::double)"
    for name, steps in severities.SEVERITIES.items()
    for i, (op, param) in [(0, ("identity", "null"))] + list(enumerate(steps, 1))
)
cte("severity_steps", f"select * from (values {SEV_VALUES}) t(severity,step,op,param)")
REQUESTS = ("clean", "jpeg_q30", "blur_s2.0", "compound_severe", "compound_moderate", "no_such_level")
cte(
    "requests",
    "select image_id, patch_no, (['clean','jpeg_q30','blur_s2.0','compound_severe','compound_moderate','no_such_level'])[((image_id+patch_no)%6+1)::int] as severity from patches",
    ("patches",),
)


@query(
    "prj05_severity_lookup",
    ("requests", "severity_steps"),
    """select r.severity, s.step, s.op, round(s.param,6) as param, s.severity is not null as known, count(*) as n from requests r
  left join severity_steps s on s.severity=r.severity group by 1,2,3,4,5""",
)
def severity_lookup(spark, sf):
    names = F.array(*[F.lit(n) for n in REQUESTS])
    requests = sizes(spark, sf).select(
        "image_id", F.element_at(names, ((F.col("image_id") + F.col("patch_no")) % 6 + 1).cast("int")).alias("severity")
    )
    found = severities.lookup(requests, severities.severity_table(spark))
    return rounded(found.groupBy("severity", "step", "op", "param", "known").agg(F.count(F.lit(1)).alias("n")))


ALLOWED_SQL = """list_filter([5e-1,25e-2], lambda s: m*s>=16) as resize_scales, list_filter([5e-1,1e0,2e0], lambda s: s<=greatest(5e-1,m/112e0)) as blur_sigmas,
  list_filter([90e0,70e0,50e0,30e0], lambda q: q>=case when m<64 then 70e0 else 0e0 end) as jpeg_qualities"""
cte("small_sides", f"select image_id, patch_no, m, {ALLOWED_SQL} from (select image_id, patch_no, least(w,h)//4 as m from patches)", ("patches",))


def small_sides(spark, sf):
    return sizes(spark, sf).select("image_id", "patch_no", F.expr("least(w,h) div 4").alias("m"))


@query("prj06_allowed_magnitudes", ("small_sides",), "select image_id, patch_no, resize_scales, blur_sigmas, jpeg_qualities from small_sides")
def allowed_magnitudes(spark, sf):
    allowed = severities.allowed_magnitudes(F.col("m"))
    return small_sides(spark, sf).select("image_id", "patch_no", *[c.alias(n) for n, c in allowed.items()])


@query(
    "prj07_effective_plan_text",
    ("small_sides",),
    "select m, 'resize_scales='||t(resize_scales)||' blur_sigmas='||t(blur_sigmas)||' jpeg_qualities='||t(jpeg_qualities) as plan, count(*) as n from small_sides group by 1,2".replace(
        "t(resize_scales)", "case when len(resize_scales)=0 then 'DISABLED' else array_to_string(list_transform(resize_scales, lambda v: printf('%.2f',v)),',') end"
    )
    .replace("t(blur_sigmas)", "case when len(blur_sigmas)=0 then 'DISABLED' else array_to_string(list_transform(blur_sigmas, lambda v: printf('%.2f',v)),',') end")
    .replace("t(jpeg_qualities)", "case when len(jpeg_qualities)=0 then 'DISABLED' else array_to_string(list_transform(jpeg_qualities, lambda v: printf('%.2f',v)),',') end"),
)
def effective_plan_text(spark, sf):
    return (
        small_sides(spark, sf)
        .groupBy("m", severities.describe_plan(F.col("m")).alias("plan"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


U = "((doc_id*7919+copy*104729+({s}+1)*611953)%10007)/10007e0"


def _pick(values: str, i: int) -> str:
    return f"({values})[(least(floor({U.format(s=2 * i + 1)}*len({values})),len({values})-1)+1)::int]"


def _step(i: int, op: str, values: str) -> str:
    p = severities.PROBABILITIES[op]
    return f"case when len({values})>0 and {U.format(s=2 * i)}<{p}::double then '{op}:'||printf('%.2f',{_pick(values, i)}) end"


AUG_SQL = " , ".join(
    [
        _step(0, "resize", "resize_scales"),
        _step(1, "center_crop", "[8e-1]"),
        _step(2, "blur", "blur_sigmas"),
        _step(3, "color_jitter", "[2e-1]"),
        _step(4, "noise", "[2e-2,5e-2,1e-1]"),
        _step(5, "jpeg", "jpeg_qualities"),
    ]
)
cte("label_copies", "select doc_id, quality, copy, copy>0 as is_aug from labels, (select unnest(range(3)) as copy)")


@query(
    "prj08_random_augmentation_plan",
    ("label_copies",),
    f"""select doc_id, copy, concat_ws(' ',{AUG_SQL}) as plan from (select *, {ALLOWED_SQL} from (select *, (16+doc_id%240) as m from label_copies where is_aug))""",
)
def augmentation_plan(spark, sf):
    copies = ds.expand_copies(fx.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", 2).where("is_aug")
    mix = F.col("doc_id") * 7919 + F.col("copy") * 104729
    uniform = lambda salt: (mix + (salt + 1) * 611953) % 10007 / F.lit(10007.0)
    planned = severities.random_plan(copies, 16 + F.col("doc_id") % 240, uniform)
    text = F.transform("plan", lambda s: F.concat(s["op"], F.lit(":"), F.format_string("%.2f", s["param"])))
    return planned.select("doc_id", "copy", F.array_join(text, " ").alias("plan"))


@query("prj09_copies_with_group_id", ("label_copies",), "select doc_id, quality, copy::int as copy, doc_id as group_id, is_aug from label_copies")
def copies_with_group(spark, sf):
    return ds.expand_copies(fx.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", 2)


@query("prj11_clean_rows", ("feat",), "select family, count(*) as n, sum(y)::bigint as fake from feat where not is_aug group by family")
def clean_rows(spark, sf):
    return ds.clean_rows(fx.feat(spark, sf)).groupBy("family").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("fake")
    )


@query(
    "prj14_working_size",
    ("patches",),
    """select image_id, patch_no, case when greatest(w,h)>512 then greatest(1,round_even(w*(512e0/greatest(w,h)),0)::int) else w::int end as work_w,
  case when greatest(w,h)>512 then greatest(1,round_even(h*(512e0/greatest(w,h)),0)::int) else h::int end as work_h from patches""",
)
def working_size(spark, sf):
    return ds.working_size(sizes(spark, sf), 512).select("image_id", "patch_no", "work_w", "work_h")


@query(
    "prj37_random_subset",
    (),
    "select doc_id, quality from labels order by (doc_id*7919+13)%10007, doc_id limit 150",
)
def random_subset(spark, sf):
    rows = fx.table(spark, sf, "labels").select("doc_id", "quality")
    return ds.random_subset(rows, 150, (F.col("doc_id") * 7919 + 13) % 10007, "doc_id")


# --- joins and sets -----------------------------------------------------------------------


@query(
    "join01_paired_views",
    ("feat",),
    "select a.sample_id, a.group_id, a.y, b.sample_id as aug_sample_id from feat a join feat b on a.group_id=b.group_id and not a.is_aug and b.is_aug",
)
def paired_views(spark, sf):
    return ds.paired_views(fx.feat(spark, sf))


@query(
    "join03_optional_mask",
    (),
    "select source, count(*) as n, count(l.doc_id) as with_mask from documents d left join labels l on l.doc_id=d.doc_id group by source",
)
def optional_mask(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "source")
    masks = fx.table(spark, sf, "labels").select("doc_id", F.lit(1).alias("mask"))
    return docs.join(masks, "doc_id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("mask").alias("with_mask")
    )


@query("join08_not_yet_recorded", (), "select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id=d.doc_id)")
def not_yet_recorded(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "source")
    return ds.not_recorded(docs, fx.table(spark, sf, "labels").select("doc_id"), "doc_id")


@query(
    "join10_dataset_by_severity",
    ("severity_steps",),
    "select source, severity, count(*) as n from documents, (select distinct severity from severity_steps) group by 1,2",
)
def dataset_by_severity(spark, sf):
    docs = fx.table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return severities.across_severities(docs, list(severities.SEVERITIES)).select("source", "severity", "n")


@query(
    "join11_concat_feature_blocks",
    ("feat",),
    "select sample_id, len(features)::int as dim, round(features[1]::double,6) as first, round(features[33]::double,6) as middle, round(features[64]::double,6) as last from feat",
)
def concat_blocks(spark, sf):
    rows = fx.feat(spark, sf)
    one = rows.select("sample_id", F.slice("features", 1, 32).alias("semantic"))
    two = rows.select("sample_id", F.slice("features", 33, 32).alias("spectral"))
    joined = one.join(two, "sample_id").withColumn("f", F.concat("semantic", "spectral"))
    at = lambda i, n: F.col("f")[i].cast("double").alias(n)
    return rounded(joined.select("sample_id", F.size("f").alias("dim"), at(0, "first"), at(32, "middle"), at(63, "last")))


@query(
    "join12_leave_one_family_out",
    ("arms",),
    """select f.family as held_family, f.n as held_n, f.fake as held_fake, sum(x.n)::bigint as train_n, sum(x.fake)::bigint as train_fake from
  (select family, count(*) as n, sum(y)::bigint as fake from arms group by family) f join (select family, count(*) as n, sum(y)::bigint as fake from arms group by family) x on x.family<>f.family group by 1,2,3""",
)
def leave_one_out(spark, sf):
    return ds.fold_totals(fx.arms(spark, sf), "family", "y")


@query(
    "join13_leakage_guard",
    (),
    "select l.doc_id from labels l where exists (select 1 from documents d where d.doc_id=l.doc_id)",
)
def leakage_guard(spark, sf):
    held_out = fx.table(spark, sf, "labels").select("doc_id")
    training = fx.table(spark, sf, "documents").select("doc_id")
    return ds.leaked(held_out, training, "doc_id")


@query(
    "set01_concatenate_roots",
    (),
    "select source, side, count(*) as n from (select source, 'real' as side from documents where n_chars%2=1 union all select source, 'fake' from documents where n_chars%2=0) group by 1,2",
)
def concatenate_roots(spark, sf):
    docs = fx.table(spark, sf, "documents").select("source", "n_chars")
    both = images.label_two_folders(docs.where(F.col("n_chars") % 2 == 1), docs.where(F.col("n_chars") % 2 == 0))
    return both.groupBy("source", F.when(F.col("label") == 1, "fake").otherwise("real").alias("side")).agg(
        F.count(F.lit(1)).alias("n")
    )


STACK_SQL = """select sample_id, cache, group_id + case cache when 0 then 0 else (select max(group_id)+1 from feat where family=0) end
   + case cache when 2 then (select max(group_id)+1 from feat where family=1) else 0 end as group_id from (select *, family as cache from feat)"""


@query("set02_stack_feature_caches", ("feat",), STACK_SQL)
def stack_feature_caches(spark, sf):
    rows = fx.feat(spark, sf)
    frames = [rows.where(F.col("family") == f) for f in (0, 1, 2)]
    return ds.union_caches(frames, [FEATURE_BLOCKS] * 3).select("sample_id", "cache", "group_id")


@query("win11_group_id_offset", ("feat",), STACK_SQL)
def group_id_offset(spark, sf):
    return ds.stack_caches(fx.feat(spark, sf).withColumn("cache", F.col("family"))).select("sample_id", "cache", "group_id")


@query(
    "set03_append_manifests",
    (),
    "select count(*) as n, count(distinct doc_id) as stems from documents where doc_id%4<>3 or doc_id%2=1",
)
def append_manifests(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("stem"))
    merged = ds.accumulate_manifest(docs.where(F.col("stem") % 4 != 3), docs.where(F.col("stem") % 2 == 1))
    return merged.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("stem").alias("stems"))


@query(
    "set04_difference_checks",
    (),
    """select source, list_sort(list_filter(langs, lambda l: not list_contains(['en','fr'],l))) as unknown, list_sort(list_filter(langs, lambda l: list_contains(['en','fr'],l))) as known from
  (select source, list(distinct lang) as langs from documents group by source)""",
)
def difference_checks(spark, sf):
    known = F.array(F.lit("en"), F.lit("fr"))
    langs = fx.table(spark, sf, "documents").groupBy("source").agg(F.collect_set("lang").alias("langs"))
    return langs.select(
        "source",
        F.sort_array(F.array_except("langs", known)).alias("unknown"),
        F.sort_array(F.array_intersect("langs", known)).alias("known"),
    )


@query(
    "set05_block_subsets",
    (),
    """select array_to_string(list_filter(list_transform(range(1,len(b)+1), lambda i: case when (m>>(i-1))&1=1 then b[i] end), lambda x: x is not null),'+') as blocks,
  list_sum(list_transform(range(1,len(b)+1), lambda i: case when (m>>(i-1))&1=1 then c[i] else 0 end))::bigint as n_documents from
  (select b, c, unnest(range(1,(1<<len(b)::int))) as m from (select list(lang order by lang) as b, list(n order by lang) as c from (select lang, count(*) as n from documents group by lang)))""",
)
def block_subsets(spark, sf):
    langs = fx.table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    packed = langs.agg(F.sort_array(F.collect_list(F.struct("lang", "n"))).alias("b"))
    subsets = packed.select(F.explode(ds.block_subsets(F.col("b"))).alias("s"))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    return subsets.select(F.array_join(F.transform("s", lambda x: x["lang"]), "+").alias("blocks"), total.alias("n_documents"))


# --- splits, caps, sorts, logs ------------------------------------------------------------


@query("win04_round_robin", (), "select turn, source, doc_id from (select *, row_number() over (partition by source order by doc_id) as turn from documents) order by turn, source limit 400")
def round_robin(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "source")
    return ds.interleave(docs, "source", ["doc_id"], 400).select("turn", "source", "doc_id")


@query(
    "win05_first_n_per_class",
    ("patches",),
    "select class, image_id, patch_no from (select *, row_number() over (partition by class order by image_id, patch_no) as r from patches) where r<=500",
)
def first_n_per_class(spark, sf):
    return ds.per_class_cap(fx.patches(spark, sf), "class", ["image_id", "patch_no"], 500).select("class", "image_id", "patch_no")


HASH = "(patch_no*7919+image_id*31)%1009"


def window_hash():
    return (F.col("patch_no") * 7919 + F.col("image_id") * 31) % 1009


@query(
    "win06_scale_sample",
    ("patches",),
    f"""select image_id, scale, patch_no from (select *, row_number() over (partition by image_id, scale order by {HASH}, patch_no) as r,
  (select count(distinct scale) from patches q where q.image_id=p.image_id) as k from patches p) where r<=greatest(1,4//k)""",
)
def scale_sample(spark, sf):
    return ds.scale_sample(fx.patches(spark, sf), 4, window_hash()).select("image_id", "scale", "patch_no")


@query(
    "win07_balanced_windows",
    ("patches",),
    f"""select image_id, patch_no, lab from (select *, case when class='tampered' then least(sum((lab=1)::int) over (partition by image_id), sum((lab=0)::int) over (partition by image_id)) else 3 end as keep from
  (select *, row_number() over (partition by image_id, lab order by {HASH}, patch_no) as r from (select *, (score>=5e-1)::int as lab from patches)) where r<=3) where r<=keep""",
)
def balanced_windows(spark, sf):
    labelled = fx.patches(spark, sf).withColumn("lab", (F.col("score") >= 0.5).cast("int"))
    return ds.balanced_windows(labelled, 3, "lab", "class", window_hash()).select("image_id", "patch_no", "lab")


@query(
    "win08_group_split",
    ("feat",),
    """select sample_id, f.group_id, r<=floor(n*2e-1) as is_val from feat f join (select group_id, row_number() over (order by (group_id*7919+17)%10007, group_id) as r, count(*) over () as n
  from (select distinct group_id from feat)) g on g.group_id=f.group_id""",
)
def group_split(spark, sf):
    rows = ds.split_by_group(fx.feat(spark, sf), "group_id", 0.2, (F.col("group_id") * 7919 + 17) % 10007)
    return rows.select("sample_id", "group_id", "is_val")


@query(
    "win09_row_split",
    (),
    "select doc_id, row_number() over (order by (doc_id*7919+17)%10007, doc_id)<=floor((select count(*) from labels)*15e-2) as is_val from labels",
)
def row_split(spark, sf):
    rows = fx.table(spark, sf, "labels").select("doc_id")
    return ds.split_by_group(rows, "doc_id", 0.15, (F.col("doc_id") * 7919 + 17) % 10007)


@query(
    "win12_best_epoch_and_patience",
    ("epochs",),
    """select run, epoch, round(best,6) as best, best_epoch, epoch-best_epoch as stale from (select *, min(epoch) over (partition by run, best) as best_epoch from
  (select *, max(val) over (partition by run order by epoch) as best from epochs))""",
)
def best_epoch(spark, sf):
    out = training_log.best_so_far(epochs(spark, sf), "run", ["event_id"], "val")
    return rounded(out.select("run", "epoch", "best", "best_epoch", "stale"))


@query(
    "win13_collapse_streak",
    ("epochs",),
    "select run, epoch, epoch - max(case when bad then 0 else epoch end) over (partition by run order by epoch) as streak from (select *, (auc<55e-2) as bad from epochs)",
)
def collapse_streak(spark, sf):
    out = training_log.collapse_streaks(epochs(spark, sf), "run", ["event_id"], F.col("auc") < 0.55)
    return out.select("run", "epoch", "streak")


@query("srt01_deterministic_order", (), "select row_number() over (order by doc_id, lang)-1 as group_id, doc_id, lang from documents")
def deterministic_order(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id", "lang")
    return ranks.positions(docs, [], ["doc_id", "lang"]).select((F.col("position") - 1).alias("group_id"), "doc_id", "lang")


@query(
    "srt06_stop_at_target",
    (),
    "select doc_id from documents d where not exists (select 1 from labels l where l.doc_id=d.doc_id) order by doc_id limit greatest(0, 500-(select count(*) from labels)::int)",
)
def stop_at_target(spark, sf):
    docs = fx.table(spark, sf, "documents").select("doc_id")
    return ds.top_up(docs, fx.table(spark, sf, "labels").select("doc_id"), "doc_id", 500)


# --- counts -------------------------------------------------------------------------------


@query(
    "agg01_class_counts",
    ("arms",),
    """select case when grouping(family)=1 then 'TOTAL' else family end as name, sum(1-y)::bigint as real, sum(y)::bigint as fake, count(*) as n, round(sum(y)/count(*)::double,6) as fake_fraction
  from arms group by rollup(family)""",
)
def class_counts(spark, sf):
    return rounded(ds.class_counts(labelled_documents(spark, sf)))


@query(
    "agg02_format_census",
    (),
    """select source, coalesce(list_sort(list(distinct lang) filter (n_chars%2=1)),[]) as real_formats, coalesce(list_sort(list(distinct lang) filter (n_chars%2=0)),[]) as fake_formats,
  len(coalesce(list(distinct lang) filter (n_chars%2=1),[]))>0 and len(coalesce(list(distinct lang) filter (n_chars%2=0),[]))>0 and
  coalesce(list_sort(list(distinct lang) filter (n_chars%2=1)),[])<>coalesce(list_sort(list(distinct lang) filter (n_chars%2=0)),[]) as differ from documents group by source""",
)
def format_census(spark, sf):
    docs = fx.table(spark, sf, "documents").select("source", "lang", (1 - F.col("n_chars") % 2).cast("int").alias("label"))
    return ds.format_census(docs, ["source"], "label", "lang")


@query(
    "agg47_shortfall",
    ("arms",),
    """select family, real, fake, greatest(0,12-real)::bigint as missing_real, greatest(0,12-fake)::bigint as missing_fake from
  (select family, sum(1-y)::bigint as real, sum(y)::bigint as fake from arms group by family) where real<12 or fake<12""",
)
def shortfall(spark, sf):
    return ds.shortfall(fx.arms(spark, sf), "family", "y", 12)
