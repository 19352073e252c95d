from pyspark.sql import functions as F

from loomwork.functions import text as T

# Nothing for a reader, one character, or hanzi without kana; what has letters or kana is kept.
HANZI_SKIP = ["", "\t \n", "!?", "〜〜", "7", "0.5%", "２０", "［］", "Z", "门", "夜色温柔，风也安静。", "卷轴 v2", "第 9 层", "MP不足", "刀鍛冶"]
HANZI_KEEP = ["Lantern", "Quit to desk", "OK", "Wait…", "LV:3", "Q7", "ランタン", "うん", "おやすみ", "刀を置け", "風です"]
CHECKS = [
    ("おやすみ", "晚安", None),
    ("おやすみ", " \n", "empty"),
    ("おやすみ", None, "empty"),
    ("【0】へ【1】を", "去【1】拿【0】", None),
    ("【0】へ【1】を", "去【0】拿", "placeholder"),
    ("【0】【0】", "【0】", "placeholder"),
    ("おやすみなさい", "おやすみなさい", "untranslated"),
    ("よるかぜ", "よるかぜ风风风", "untranslated"),
    ("よるかぜ", "よるか风风风", None),
    ("うん", "译文:嗯", "prefix_residue"),
    ("うん", "嗯" * 121, "too_long"),
    ("うん", "嗯" * 120, None),
    ("Lantern", "灯", None),
]


def test_should_skip(spark):
    rows = spark.createDataFrame([(x, True) for x in HANZI_SKIP] + [(x, False) for x in HANZI_KEEP], "x string, want boolean")
    wrong = rows.withColumn("got", T.should_skip(F.col("x"), "hanzi")).filter("got <> want").collect()
    assert wrong == []


def test_check_immediate(spark):
    rows = spark.createDataFrame(CHECKS, "o string, t string, want string")
    wrong = rows.withColumn("got", T.check_immediate(F.col("o"), F.col("t"))).filter("not (got <=> want)").collect()
    assert wrong == []
