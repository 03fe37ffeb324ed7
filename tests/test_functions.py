import pytest
from pyspark.sql import functions as F

from frondlake.functions import flags, text, vectors


@pytest.mark.parametrize("given, want", [
    ("Sweet Corn", "sweet_corn"), ("  Leaf--Spot / Gray! ", "leaf_spot_gray"), ("Straße 9", "strasse_9"),
    ("ﬁeld", "field"), ("!!!", ""), ("É a", "a"), ("ẞ", "ss"),
])
def test_slug(one_value, given, want):
    assert one_value(text.slug(F.lit(given))) == want


def test_empty_slug_is_an_error(one_value):
    with pytest.raises(Exception, match="crop must contain letters or numbers"):
        one_value(text.checked_slug(F.lit("--"), "crop"))


@pytest.mark.parametrize("given", ["leaf_rust_2nd", "x", "sweet_corn", "abc123def", "a_1b"])
def test_title_words_capitalise_after_any_non_letter(one_value, given):
    assert one_value(text.title_words(F.lit(given))) == given.replace("_", " ").title()


def test_derived_names(one_value):
    crop, disease = F.lit("corn"), F.lit("leaf_rust")
    assert one_value(text.class_key(crop, disease)) == "corn__leaf_rust"
    assert one_value(text.class_directory(crop, disease)) == "corn/leaf_rust"
    assert one_value(text.class_display_name(crop, disease)) == "Corn Leaf Rust"


@pytest.mark.parametrize("value, pattern, want", [
    ("ABC", "%bc", True), ("É", "é", False), ("a\\b", "%\\%", True), ("a%b", "a%b", True),
    ("x__unhealthy", "%__healthy", True), ("X__HEALTHY", "%__healthy", True), ("xhealthy", "%__healthy", False),
    ("line\nbreak", "line%break", True),
])
def test_folded_like(one_value, value, pattern, want):
    assert one_value(text.folded_like(F.lit(value), pattern)) is want


@pytest.mark.parametrize("value, digits", [(0.35, 1), (2.25, 1), (1.015, 2), (0.125, 2), (1.0 / 3, 4), (1234.5, 0)])
def test_rounding_is_half_even_on_the_binary_value(one_value, value, digits):
    assert one_value(text.rounded(F.lit(value), digits)) == round(value, digits)


@pytest.mark.parametrize("value, total", [(1, 3), (0, 5), (5, 0), (7, -1), (1, 800)])
def test_percent_text(one_value, value, total):
    want = "0.00%" if total <= 0 else f"{value / total * 100:.2f}%"
    assert one_value(text.percent_text(F.lit(value), F.lit(total))) == want


def test_ratio_text(one_value):
    assert one_value(text.ratio_text(F.lit(7), F.lit(2))) == "3.50:1"
    assert one_value(text.ratio_text(F.lit(7), F.lit(0))) == "N/A"


@pytest.mark.parametrize("size, want", [
    (0, "0.00 B"), (1023, "1023.00 B"), (1024, "1.00 KB"), (1536, "1.50 KB"), (1024 ** 2, "1.00 MB"),
    (1024 ** 3, "1.00 GB"), (1024 ** 4, "1.00 TB"), (5 * 1024 ** 5, "5120.00 TB"),
])
def test_byte_size_text(one_value, size, want):
    assert one_value(text.byte_size_text(F.lit(size))) == want


@pytest.mark.parametrize("path, want", [
    ("a/b.JPG", ".jpg"), ("a.b/c", ""), ("a/.png", ""), ("x.tar.gz", ".gz"), ("a/b..jpg", ".jpg"), ("noext", ""),
])
def test_file_extension(one_value, path, want):
    assert one_value(text.file_extension(F.lit(path))) == want


@pytest.mark.parametrize("score, band", [
    (100, "EXCELLENT"), (90, "EXCELLENT"), (89, "GOOD"), (80, "GOOD"), (79, "FAIR"), (70, "FAIR"),
    (69, "NEEDS IMPROVEMENT"), (50, "NEEDS IMPROVEMENT"), (49, "POOR"),
])
def test_score_band(one_value, score, band):
    assert one_value(text.score_band(F.lit(score))) == band


def _resolution(one_value, width, height):
    made = flags.resolution_flags(F.lit(width).cast("int"), F.lit(height).cast("int"))
    row = one_value(F.struct(*[c.alias(n) for n, c in made.items()]))
    return row["small"], row["below_ideal_resolution"], row["severely_undersized"]


@pytest.mark.parametrize("width, height, want", [
    (300, 300, (False, True, False)), (299, 300, (True, True, False)), (450, 450, (False, False, False)),
    (449, 900, (False, True, False)), (150, 150, (True, True, False)), (149, 500, (True, True, True)),
    (None, None, (False, False, False)),
])
def test_resolution_flags(one_value, width, height, want):
    assert _resolution(one_value, width, height) == want


@pytest.mark.parametrize("ratio, want", [(0.35, False), (0.3499, True), (2.85, False), (2.8501, True), (None, False)])
def test_extreme_aspect(one_value, ratio, want):
    assert one_value(flags.extreme_aspect(F.lit(ratio).cast("double"))) is want


def test_aspect_of_height_zero_is_null(one_value):
    assert one_value(flags.aspect_ratio(F.lit(10), F.lit(0))) is None


@pytest.mark.parametrize("size, tiny, large", [
    (5119, True, False), (5120, False, False), (10485760, False, False), (10485761, False, True),
])
def test_size_flags(one_value, size, tiny, large):
    made = flags.size_flags(F.lit(size))
    assert one_value(made["tiny_file"]) is tiny
    assert one_value(made["large_file"]) is large


@pytest.mark.parametrize("mode, transparent, channels, gray, alpha", [
    ("1", False, 1, True, False), ("L", False, 1, True, False), ("LA", False, 2, True, True),
    ("P", False, 1, False, False), ("P", True, 1, False, True), ("RGB", True, 3, False, False),
    ("RGBA", False, 4, False, True), ("CMYK", False, 4, False, False), ("I;16", False, None, False, False),
    ("LAB", False, None, False, True), (None, False, None, False, False),
])
def test_mode_flags(one_value, mode, transparent, channels, gray, alpha):
    made = flags.mode_flags(F.lit(mode).cast("string"), F.lit(transparent))
    row = one_value(F.struct(*[c.alias(n) for n, c in made.items()]))
    assert (row["channels"], row["grayscale"], row["has_alpha"]) == (channels, gray, alpha)


def test_difference_hash_packs_row_major_first_bit_highest(one_value):
    grid = [5, 4, 4, 1, 2, 0]  # rows 5>4, 4=4 | 1<2, 2>0
    column = F.array(*[F.lit(x) for x in grid])
    assert one_value(vectors.difference_hash(column, 3, 2)) == 0b1001


def test_difference_hash_uses_all_64_bits(one_value):
    falling = F.array(*[F.lit(9 - i % 9) for i in range(72)])
    assert one_value(vectors.difference_hash(falling, 9, 8)) == -1
    assert one_value(vectors.hash_text(vectors.difference_hash(falling, 9, 8))) == "f" * 16
    assert one_value(vectors.hash_text(F.lit(10).cast("bigint"))) == "000000000000000a"
    with pytest.raises(ValueError):
        vectors.difference_hash(falling, 10, 8)


def test_hamming_distance_of_negative_values(one_value):
    assert one_value(vectors.hamming_distance(F.lit(-1).cast("bigint"), F.lit(0).cast("bigint"))) == 64


def test_top_k_breaks_ties_by_class_and_caps_k(one_value):
    p = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.25))
    rows = one_value(vectors.top_k(p, 9))
    assert [(r["rank"], r["class_index"], r["confidence"]) for r in rows] == [(1, 1, 0.5), (2, 0, 0.25), (3, 2, 0.25)]
    with pytest.raises(ValueError):
        vectors.top_k(p, 0)


def test_softmax_of_large_logits(one_value):
    p = one_value(vectors.softmax(F.array(F.lit(1000.0), F.lit(1000.0))))
    assert p == [0.5, 0.5]
    assert one_value(vectors.argmax(F.array(F.lit(2.0), F.lit(3.0), F.lit(3.0)))) == 1


def test_normalize_channels(one_value):
    pixels = F.array(*[F.lit(v) for v in (255, 0, 51, 0)])
    got = one_value(vectors.normalize_channels(pixels, (0.5, 0.4, 0.2), (0.5, 0.2, 0.1)))
    assert got == pytest.approx([1.0, -2.0, 0.0, -1.0])
