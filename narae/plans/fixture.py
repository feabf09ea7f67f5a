"""Documents that exercise the Korean rules: whole ``documents`` texts with a sentence of ours after each.

The driver's texts have no Hangul. Sentence k follows the text of each document whose doc_id leaves
remainder k; the same rows in Spark and in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One sentence or two of errors and near misses each, written for this table.
SENTENCES = [
    "우리는 몇일 동안 금새 지쳤고 며칠 뒤에 금세 나았다",
    "그 일은 어의없게도 역활을 나누다 생겼고 역할은 그대로다",
    "왠만하면 오랫만에 만나자고 했지만 웬만하면 오랜만에 보자",
    "도데체 어쨋든 하마트면 큰일이 났고 도대체 어쨌든 하마터면",
    "통채로 꺼꾸로 짜집기한 안성마춤 글은 통째로 고쳤다",
    "이미 됬고 내일 뵈요 하지만 됐고 내일 봬요",
    "깨끗히 곰곰히 일일히 꼼꼼이 솔직이 적었고 깨끗이 곰곰이 보았다",
    "메세지와 컨텐츠와 메뉴얼과 악세사리는 메시지와 콘텐츠로",
    "그뿐만아니라 데이터 베이스도 왠일인지 할께",
    "찌게와 육계장을 곱배기로 가장 최고로 쳤다",
    "설겆이를 승락하고 귀뜸을 받은 뒷굼치 구렛나루 윗어른",
    "과반수 이상의 웹부라우저는 제가 제 자신을 속인다",
    "가지 안았다 그리고 않 간다 라고 했습니다습니다",
    "할수 있다 끝낼수 알수없다 알수 있다 좋을것 같다 올것 같다",
    "될것이다 할거야 본적 있다 만난적 있다 해본적 없다 알줄 안다",
    "기다릴뿐이다 만날때 하는중 할 수 밖에 없다",
    "되서 되요 되야 됀 일은 될 것이고 되도 안 된다",
    "돼게 돼고 돼는 돼면서 돼도록 하지만 돼요",
    "할려고 먹을려면 읽을려고 잡을려면 갈려고 갈려면 가려고",
    "감사해용 하세용 그리고 용감해요",
    "읽읍니다 갑읍니까 하읍니다 알읍니다 읽습니다",
    "확인하십시요 오십시요 가십시오 아니예요 아니에요",
    "않됩니다 않돼요 않되 않된다 안 됩니다",
    "묵을데가 쓸데가 입은채로 산채로 모르는듯하다 그럴듯하다",
    "먹을만큼 마을만큼 들은대로 가을대로 사는법이다 요리법이다",
    "잊을리가 없다 물리가 없다 갈리는 없다 잊을리가 있다",
    "커피던지 차던지 물이던지 마시고 가던지 말고 오던지",
    "사과던지 배던지 감던지 고르자",
    "책를 책와 책로 책는 사과는 물로 문서을 읽고",
    "나무이 학교이 친구이 오고 책은 사과은 문제을 코드과 자료으로 본다",
    "사과,배,,감 그리고 포도,,, 모두 샀다",
    "끝났다.다음 정말!그래 왜?아니 3.일 수도 있다",
    "여기에 빈칸이 있다 . 그리고 여기도  ! 또\t?",
    "문서를 문서를 고치고 아주 아주 아주 길게 그때 그때 본다",
    "을을 책을을 나는는 물은은은 그를를를를",
    "자료는 foo@bar.kr 와 http://a.kr/몇일 에 있고 #몇일 그리고 몇일.txt파일 뿐이다",
]


def korean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, lang, source): every document, its whole text and a sentence."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = spark.range(1).select(F.posexplode(F.array(*[F.lit(s) for s in SENTENCES])).alias("k", "sentence"))
    joined = docs.join(F.broadcast(rows), F.pmod(F.col("doc_id"), F.lit(len(SENTENCES))) == F.col("k"))
    return joined.select("doc_id", F.concat_ws(" ", F.coalesce("text", F.lit("")), "sentence").alias("text"), "lang", "source")


def sql_values() -> str:
    return ", ".join("({}, '{}')".format(k, s.replace("'", "''")) for k, s in enumerate(SENTENCES))


#: The same documents and their words in DuckDB. gap: what stands before a word; start: code points before it.
KOREAN = f"""
ko AS (
  SELECT doc_id, coalesce(text, '') || ' ' || v.s AS text, lang, source
  FROM documents JOIN (VALUES {sql_values()}) v(k, s) ON doc_id % {len(SENTENCES)} = v.k),
cut AS (
  SELECT doc_id, text, string_split_regex(text, '[가-힣]+') AS gaps, regexp_extract_all(text, '[가-힣]+') AS ws FROM ko),
spread AS (SELECT doc_id, text, gaps, ws, unnest(generate_series(1, len(ws))) AS i FROM cut),
marked AS (
  SELECT doc_id, text, i, ws[i] AS word, gaps[i] AS gap, gaps[i + 1] AS then_gap, ws[i - 1] AS prev, ws[i + 1] AS next,
         CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ws[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM spread),
words AS (
  SELECT * FROM marked
  WHERE NOT regexp_matches(word || then_gap, '^[가-힣]+\\.txt') AND NOT regexp_matches(gap, '[/#]$')
    AND NOT (regexp_matches(gap, '^\\.txt$') AND prev = '몇일'))
"""
