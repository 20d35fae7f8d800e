"""Frame queries: generators and kernels, exploded to pixels for comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.catalog import query
from millrace.functions import pixels as px

WIDTH, HEIGHT, FRAMES = 32, 24, 4


def gradient_frames(spark, frames: int = FRAMES, width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """Frame n starts its bands at n, n div 10 and n div 100."""
    n = F.col("frameno")
    return px.bounded(spark).range(frames).select(
        F.col("id").cast("int").alias("frameno"),
    ).select("frameno", F.lit(width).alias("width"), F.lit(height).alias("height"), px.gradient(width, height, n * 37, F.call_function("div", n * 101, F.lit(10)).cast("int"), n * 5).alias("data"))


def pixels(frames: DataFrame, data, width, bands: int = 3) -> DataFrame:
    """frameno, y, x, band, v."""
    flat = frames.select("frameno", width.alias("w"), F.posexplode(data).alias("i", "v"))
    pixel = F.call_function("div", F.col("i"), F.lit(bands))
    return flat.select(
        "frameno", F.call_function("div", pixel, F.col("w")).cast("int").alias("y"), F.pmod(pixel, F.col("w")).cast("int").alias("x"), F.pmod("i", F.lit(bands)).cast("int").alias("band"), "v"
    )


_G = f"""g AS (SELECT n::INT AS frameno, y::INT AS y, x::INT AS x, band::INT AS band,
  CAST(CASE band WHEN 0 THEN n * 37 + x WHEN 1 THEN n * 101 // 10 + y ELSE n * 5 END % 256 AS INT) AS v
  FROM range({FRAMES}) a(n), range({HEIGHT}) b(y), range({WIDTH}) c(x), range(3) d(band))"""


def _frame_query(name: str, oracle: str):
    def add(fn):
        def run(spark, sf_dir):
            return fn(gradient_frames(spark))

        run.__doc__ = fn.__doc__
        return query(name, f"WITH {_G} {oracle}")(run)

    return add


def W():
    return F.col("width")


def H():
    return F.col("height")


def D():
    return F.col("data")



@_frame_query("gradient_image", "SELECT * FROM g")
def q_gradient(f):
    return pixels(f, D(), W())


def _conv_sql(kernel, weight):
    flat = [(dy, dx, kernel[dy + 1][dx + 1]) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    values = ", ".join(f"({dy}, {dx}, {k})" for dy, dx, k in flat)
    return f"""SELECT g.frameno, g.y, g.x, g.band, CAST(CASE WHEN g.y IN (0, {HEIGHT - 1}) OR g.x IN (0, {WIDTH - 1}) THEN any_value(g.v)
      ELSE greatest(0, least(255, (sum(k.k * n.v) + {weight // 2}) // {weight})) END AS INT) AS v
      FROM g JOIN (VALUES {values}) k(dy, dx, k) ON TRUE LEFT JOIN g n ON n.frameno = g.frameno AND n.band = g.band AND n.y = g.y + k.dy AND n.x = g.x + k.dx
      GROUP BY g.frameno, g.y, g.x, g.band"""


@_frame_query("conv3x3_sharpen", _conv_sql(px.SHARPEN, 1))
def q_sharpen(f):
    return pixels(f, px.convolve(D(), W(), H(), px.SHARPEN, 1), W())


@_frame_query("conv3x3_blur", _conv_sql(px.BLUR, 9))
def q_blur(f):
    return pixels(f, px.convolve(D(), W(), H(), px.BLUR, 9), W())


@_frame_query("box_downscale", "SELECT frameno, y // 2 AS y, x // 2 AS x, band, CAST((sum(v) + 2) // 4 AS INT) AS v FROM g GROUP BY frameno, y // 2, x // 2, band")
def q_box(f):
    return pixels(f, px.box_down(D(), W(), H(), 2), F.lit(WIDTH // 2))


def _g_sql(n: str, y: str, x: str, band: str) -> str:
    """A sample of the gradient, worked out in place."""
    return f"(CASE {band} WHEN 0 THEN {n} * 37 + {x} WHEN 1 THEN {n} * 101 // 10 + {y} ELSE {n} * 5 END % 256)"


def _up_sql(n: str, y: str, x: str, band: str, width: int, height: int) -> str:
    """A sample of the gradient scaled up by 2: weights in halves, rounded half up."""
    y0, x0, y1, x1 = f"({y}) // 2", f"({x}) // 2", f"least(({y}) // 2 + 1, {height - 1})", f"least(({x}) // 2 + 1, {width - 1})"
    fy, fx = f"(({y}) % 2)", f"(({x}) % 2)"
    v = lambda yy, xx: _g_sql(n, yy, xx, band)
    return f"(((2 - {fy}) * ((2 - {fx}) * {v(y0, x0)} + {fx} * {v(y0, x1)}) + {fy} * ((2 - {fx}) * {v(y1, x0)} + {fx} * {v(y1, x1)}) + 2) // 4)"


@_frame_query("bilinear_upscale", f"SELECT n::INT AS frameno, y::INT AS y, x::INT AS x, band::INT AS band, CAST({_up_sql('n', 'y', 'x', 'band', WIDTH, HEIGHT)} AS INT) AS v FROM range({FRAMES}) a(n), range({2 * HEIGHT}) b(y), range({2 * WIDTH}) c(x), range(3) d(band)")
def q_bilinear(f):
    return pixels(f, px.bilinear_up(D(), W(), H(), 2), F.lit(WIDTH * 2))


@_frame_query("nearest_scale", f"SELECT frameno, ty::INT AS y, tx::INT AS x, band, v FROM g, range(18) p(ty), range(40) q(tx) WHERE y = ty * {HEIGHT} // 18 AND x = tx * {WIDTH} // 40")
def q_nearest(f):
    return pixels(f, px.nearest(D(), W(), H(), 40, 18), F.lit(40))


@_frame_query("replicate_2x2", "SELECT frameno, (y * 2 + dy)::INT AS y, (x * 2 + dx)::INT AS x, band, v FROM g, range(2) p(dy), range(2) q(dx)")
def q_replicate(f):
    return pixels(f, px.replicate(D(), W(), H(), 2), W() * 2)


MATRIX = ((0.25, 0.5, 0.25), (1.0, -0.5, 0.0), (0.0, 0.75, 0.5))


@_frame_query(
    "colour_matrix",
    """SELECT p.frameno, p.y, p.x, m.band::INT AS band, CAST(greatest(0, least(255, floor(CAST(m.r AS DOUBLE) * p.r + CAST(m.g AS DOUBLE) * p.g + CAST(m.b AS DOUBLE) * p.b + CAST(0.5 AS DOUBLE)))) AS INT) AS v
       FROM (SELECT frameno, y, x, max(v) FILTER (band = 0) AS r, max(v) FILTER (band = 1) AS g, max(v) FILTER (band = 2) AS b FROM g GROUP BY frameno, y, x) p,
            (VALUES (0, 0.25, 0.5, 0.25), (1, 1.0, -0.5, 0.0), (2, 0.0, 0.75, 0.5)) m(band, r, g, b)""",
)
def q_matrix(f):
    return pixels(f, px.colour_matrix(D(), W(), H(), MATRIX), W())


@_frame_query("channel_gain", "SELECT frameno, y, x, band, CAST(least(255, floor(v * CASE band WHEN 0 THEN CAST(1.5 AS DOUBLE) WHEN 1 THEN CAST(0.5 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END)) AS INT) AS v FROM g")
def q_gain(f):
    return pixels(f, px.channel_gain(D(), (1.5, 0.5, 1.0)), W())


@_frame_query("depth_24_48_24", "SELECT frameno, y, x, band, v FROM g")
def q_depth(f):
    return pixels(f, px.depth_48_to_24(px.depth_24_to_48(D())), W())


@_frame_query("depth_reduce", "SELECT frameno, y, x, band, CAST((v * 255) // 256 AS INT) AS v FROM g")
def q_depth_reduce(f):
    return pixels(f, px.depth_reduce(px.depth_24_to_48(D())), W())


@_frame_query("alpha_strip", "SELECT frameno, y, x, band, v FROM g")
def q_alpha(f):
    """Frames with an alpha sample after each pixel, stripped again."""
    rgba = F.flatten(F.transform(F.sequence(F.lit(0), W() * H() - 1), lambda i: F.concat(F.slice(D(), i * 3 + 1, F.lit(3)), F.array(F.lit(255)))))
    return pixels(f, px.alpha_strip(rgba), W())


@_frame_query("slice_concat", "SELECT frameno, y, x, band, v FROM g")
def q_slices(f):
    """Nine slices of rows, joined again in order."""
    bound = lambda i: F.call_function("div", i * H(), F.lit(9)).cast("int")
    joined = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: px.slice_rows(D(), W(), bound(i), bound(i + 1))))
    return pixels(f, joined, W())


@_frame_query("image_checksum", "SELECT frameno, CAST(sum(CASE WHEN v > 127 THEN v - 256 ELSE v END) AS BIGINT) AS total FROM g GROUP BY frameno")
def q_checksum(f):
    return f.select("frameno", px.checksum(D()).alias("total"))


@_frame_query(
    "rgb_yuv420",
    f"""SELECT frameno, (y * {WIDTH} + x)::INT AS place, CAST(16 + trunc(CAST(0.257 AS DOUBLE) * r + CAST(0.504 AS DOUBLE) * g + CAST(0.098 AS DOUBLE) * b) AS INT) AS v FROM
         (SELECT frameno, y, x, max(v) FILTER (band = 0) AS r, max(v) FILTER (band = 1) AS g, max(v) FILTER (band = 2) AS b FROM g GROUP BY ALL)
       UNION ALL
       SELECT frameno, ({WIDTH * HEIGHT} + p * {WIDTH * HEIGHT // 4} + y * {WIDTH // 2} + x)::INT,
         CAST(128 + trunc(CASE p WHEN 0 THEN CAST(-0.148 AS DOUBLE) * r + CAST(-0.291 AS DOUBLE) * g + CAST(0.439 AS DOUBLE) * b
                                 ELSE CAST(0.439 AS DOUBLE) * r + CAST(-0.368 AS DOUBLE) * g + CAST(-0.071 AS DOUBLE) * b END) AS INT)
       FROM (SELECT frameno, y // 2 AS y, x // 2 AS x, sum(v) FILTER (band = 0) // 4 AS r, sum(v) FILTER (band = 1) // 4 AS g, sum(v) FILTER (band = 2) // 4 AS b
             FROM g GROUP BY frameno, y // 2, x // 2), range(2) q(p)""",
)
def q_yuv(f):
    return f.select("frameno", F.posexplode(px.to_yuv420(D(), W(), H())).alias("place", "v"))


@query("constant_image", f"SELECT y::INT AS y, x::INT AS x, band::INT AS band, CAST(CASE band WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 255 END AS INT) AS v FROM range({HEIGHT}) a(y), range({WIDTH}) b(x), range(3) c(band)")
def q_constant(spark, sf_dir):
    one = spark.range(1).select(F.lit(0).alias("frameno"), px.constant(WIDTH, HEIGHT, 10, 20, 255).alias("data"))
    return pixels(one, D(), F.lit(WIDTH)).drop("frameno")


@query("gradient48_box", f"""SELECT y::INT AS y, x::INT AS x, band::INT AS band, CAST(sum(v) // 4 AS INT) AS v FROM (SELECT y // 2 AS y, x // 2 AS x, band, CASE band WHEN 0 THEN 200 * x WHEN 1 THEN 200 * y ELSE 32512 END AS v
    FROM range({HEIGHT}) a(y), range({WIDTH}) b(x), range(3) c(band)) GROUP BY ALL""")
def q_gradient48(spark, sf_dir):
    """48-bit frames keep 16 bits a sample; the box mean truncates."""
    one = spark.range(1).select(F.lit(0).alias("frameno"), F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"), px.gradient48(WIDTH, HEIGHT).alias("data"))
    return pixels(one, px.box_down(D(), W(), H(), 2, rounded=False), F.lit(WIDTH // 2)).drop("frameno")


@query("clock_hand", "SELECT i::INT AS frame, CAST(trunc(180 + 100 * sin(2 * pi() * i / 25) + CAST(0.00001 AS DOUBLE)) AS INT) AS x, CAST(trunc(144 - 100 * cos(2 * pi() * i / 25) + CAST(0.00001 AS DOUBLE)) AS INT) AS y FROM range(30) r(i)")
def q_clock_hand(spark, sf_dir):
    """Where a clock's hand ends in each of 30 frames, a turn being 25."""
    angle = 2 * F.pi() * F.col("id") / 25
    return spark.range(30).select(F.col("id").cast("int").alias("frame"), (180 + 100 * F.sin(angle) + 0.00001).cast("int").alias("x"), (144 - 100 * F.cos(angle) + 0.00001).cast("int").alias("y"))


@query(
    "clock_commands",
    """SELECT i::INT AS frame, printf('convert -size 360x288 xc:white -stroke black -draw "line 180,144 %d,%d" frame%05d.ppm',
              CAST(trunc(180 + 100 * sin(2 * pi() * i / 25) + CAST(0.00001 AS DOUBLE)) AS INT), CAST(trunc(144 - 100 * cos(2 * pi() * i / 25) + CAST(0.00001 AS DOUBLE)) AS INT), i::INT) AS command FROM range(30) r(i)""",
)
def q_clock_commands(spark, sf_dir):
    """One command line for each frame of the clock, to be run by whatever draws."""
    hand = q_clock_hand(spark, sf_dir)
    return hand.select("frame", F.format_string('convert -size 360x288 xc:white -stroke black -draw "line 180,144 %d,%d" frame%05d.ppm', "x", "y", "frame").alias("command"))


#: The recorded workload: frames of this size, scaled up by two, sharpened, encoded.
VIDEO_WIDTH, VIDEO_HEIGHT, VIDEO_FACTOR = 720, 576, 2


def video_frames(spark, frames: int, per_task: int = 8, width: int = VIDEO_WIDTH, height: int = VIDEO_HEIGHT) -> DataFrame:
    """frameno and packed frame, generated where they are worked on."""
    n = F.col("frameno")
    numbers = px.bounded(spark).range(0, frames, 1, max(1, min(frames, -(-frames // per_task)))).select(F.col("id").cast("int").alias("frameno"))
    return numbers.select("frameno", px.packed_gradient(width, height, n * 37, F.call_function("div", n * 101, F.lit(10)).cast("int"), n * 5).alias("frame"))


def _sharp(a):
    return px.convolved(a, px.SHARPEN, 1)


def _twice(a):
    return px.scaled_up(a, VIDEO_FACTOR)


def video_workload(spark, frames: int, per_task: int = 8) -> DataFrame:
    """frameno and encoded frame: generate, scale up, sharpen, encode; a frame never leaves its task."""
    return video_frames(spark, frames, per_task).select("frameno", px.chain(F.col("frame"), _twice, _sharp, px.deflated).alias("encoded"))


def _video_sql(frames: int) -> str:
    w, h = VIDEO_WIDTH * VIDEO_FACTOR, VIDEO_HEIGHT * VIDEO_FACTOR
    up = lambda dy, dx: _up_sql("n", f"y + {dy}", f"x + {dx}", "band", VIDEO_WIDTH, VIDEO_HEIGHT)
    around = " + ".join(up(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
    return f"""SELECT n::INT AS frameno, {w} AS width, {h} AS height, CAST(sum(CASE WHEN v > 127 THEN v - 256 ELSE v END) AS BIGINT) AS total
      FROM (SELECT n, CASE WHEN y IN (0, {h - 1}) OR x IN (0, {w - 1}) THEN {up(0, 0)} ELSE greatest(0, least(255, 9 * {up(0, 0)} - ({around}))) END AS v
            FROM range({frames}) a(n), range({h}) b(y), range({w}) c(x), range(3) d(band)) GROUP BY n"""


@query("video_workload", _video_sql(2))
def q_video(spark, sf_dir):
    """The recorded workload on two frames of its size: dimensions and checksum of what the encoder is given."""
    frames = video_frames(spark, 2, 1).select("frameno", px.chain(F.col("frame"), _twice, _sharp).alias("frame"))
    big = lambda at: F.conv(F.hex(F.substring("frame", at, 4)), 16, 10).cast("int")
    return frames.select("frameno", big(5).alias("width"), big(9).alias("height"), px.packed_checksum(F.col("frame")).alias("total"))
