"""The rule tables: what is written wrongly, and how it is written. Facts of Korean orthography as the rules fix them."""

from __future__ import annotations

# Literal rules (id, severity, least profile, fix safety, [(from, to), ...]).
LITERALS: list[tuple[str, str, str, str, list[tuple[str, str]]]] = [
    ("spelling.lexical.myeochil", "error", "default", "safe", [("몇일", "며칠")]),
    ("spelling.lexical.geumse", "error", "default", "safe", [("금새", "금세")]),
    ("spelling.lexical.eoieopda", "error", "default", "safe", [("어의없", "어이없")]),
    ("spelling.lexical.yeokhal", "error", "default", "safe", [("역활", "역할")]),
    ("spelling.confusable.wen-waen", "error", "default", "safe", [("왠만", "웬만"), ("웬지", "왠지")]),
    ("spelling.lexical.huihanhada", "error", "default", "safe", [("희안", "희한")]),
    ("spelling.confusable.oraen-oraet", "error", "default", "safe", [("오랫만에", "오랜만에"), ("오랜동안", "오랫동안")]),
    ("spelling.lexical.dodaeche", "error", "default", "safe", [("도데체", "도대체")]),
    ("spelling.lexical.eojjaetdeun", "error", "default", "safe", [("어쨋든", "어쨌든")]),
    ("spelling.lexical.hamatteomyeon", "error", "default", "safe", [("하마트면", "하마터면")]),
    ("spelling.lexical.tongjjaero", "error", "default", "safe", [("통채로", "통째로")]),
    ("spelling.lexical.geokkuro", "error", "default", "safe", [("꺼꾸로", "거꾸로")]),
    ("spelling.lexical.jjagipgi", "error", "default", "safe", [("짜집기", "짜깁기")]),
    ("spelling.lexical.anseong-matchum", "error", "default", "safe", [("안성마춤", "안성맞춤")]),
    ("spelling.conjugation.dwaet", "error", "default", "safe", [("됬", "됐")]),
    ("spelling.conjugation.boe-bwae", "error", "default", "safe", [("뵈요", "봬요")]),
    ("spelling.adverb.i-hi", "error", "default", "safe", [("깨끗히", "깨끗이"), ("곰곰히", "곰곰이"), ("일일히", "일일이"), ("틈틈히", "틈틈이"), ("번번히", "번번이"), ("더욱히", "더욱이"), ("꼼꼼이", "꼼꼼히"), ("솔직이", "솔직히")]),
    ("spelling.lexical.gaesu", "error", "default", "safe", [("갯수", "개수")]),
    ("spelling.lexical.chojeom", "error", "default", "safe", [("촛점", "초점")]),
    ("spelling.lexical.daega", "error", "default", "safe", [("댓가", "대가")]),
    ("spelling.loanword.curated", "warning", "default", "safe", [("메세지", "메시지"), ("컨텐츠", "콘텐츠"), ("메뉴얼", "매뉴얼"), ("악세사리", "액세서리"), ("리더쉽", "리더십"), ("네비게이션", "내비게이션"), ("바베큐", "바비큐"), ("밧데리", "배터리"), ("카다로그", "카탈로그"), ("카달로그", "카탈로그"), ("디지탈", "디지털"), ("레져", "레저"), ("쥬스", "주스"), ("후라이팬", "프라이팬"), ("로보트", "로봇"), ("케잌", "케이크")]),
    ("spacing.fixed.ppunman-anira", "warning", "default", "safe", [("뿐만아니라", "뿐만 아니라")]),
    ("spelling.lexical.jjigae", "error", "strict", "review", [("찌게", "찌개")]),
    ("spelling.lexical.yukgaejang", "error", "default", "safe", [("육계장", "육개장")]),
    ("spelling.lexical.gop-ppaegi", "error", "default", "safe", [("곱배기", "곱빼기")]),
    ("style.redundancy.gajang-choego", "info", "editorial", "review", [("가장 최고", "최고")]),
    ("spacing.compound.database", "warning", "default", "safe", [("데이터 베이스", "데이터베이스")]),
    ("spelling.confusable.waen-il", "error", "default", "safe", [("왠일", "웬일")]),
    ("grammar.ending.hal-ge", "error", "default", "safe", [("할께", "할게")]),
    ("punctuation.duplicate.comma", "warning", "default", "safe", [(",,", ",")]),
    ("style.redundancy.majority-over", "info", "editorial", "review", [("과반수 이상", "과반수")]),
    ("technical.term.web-browser", "error", "default", "safe", [("웹부라우저", "웹 브라우저")]),
    ("advanced.honorific.jeo-jasin", "info", "editorial", "review", [("제가 제 자신을", "제가 저 자신을")]),
    ("spelling.lexical.seolgeoji", "error", "default", "safe", [("설겆이", "설거지")]),
    ("spelling.lexical.seungnak", "error", "default", "safe", [("승락", "승낙")]),
    ("spelling.lexical.gwittuim", "error", "default", "safe", [("귀뜸", "귀띔")]),
    ("spelling.lexical.neoljjikhada", "error", "default", "safe", [("넓직하다", "널찍하다")]),
    ("spelling.lexical.jjejjehada", "error", "default", "safe", [("째째하다", "쩨쩨하다")]),
    ("spelling.lexical.sutgarak", "error", "default", "safe", [("숫가락", "숟가락")]),
    ("spelling.lexical.dwikkumchi", "error", "default", "safe", [("뒷굼치", "뒤꿈치")]),
    ("spelling.lexical.gurenarut", "error", "default", "safe", [("구렛나루", "구레나룻")]),
    ("spelling.lexical.uteoreun", "error", "default", "safe", [("윗어른", "웃어른")]),
    ("spelling.lexical.haesseukhada", "error", "default", "safe", [("핼쓱하다", "해쓱하다")]),
    ("spelling.lexical.umcheurida", "error", "default", "safe", [("움추리다", "움츠리다")]),
    ("spelling.lexical.aedalpeuda", "error", "default", "safe", [("애닯다", "애달프다")]),
    ("spelling.lexical.iljjiki", "error", "default", "safe", [("일찌기", "일찍이")]),
    ("spelling.lexical.dakdalhada", "error", "default", "safe", [("닥달하다", "닦달하다")]),
    ("spelling.lexical.dwichidakkeori", "error", "default", "safe", [("뒤치닥거리", "뒤치다꺼리")]),
    ("spelling.lexical.heoguhan-nal", "error", "default", "safe", [("허구헌날", "허구한 날")]),
    ("spelling.lexical.hyeolhyeoldansin", "error", "default", "safe", [("홀홀단신", "혈혈단신")]),
    ("spelling.lexical.gwebyeon", "error", "default", "safe", [("괴변", "궤변")]),
    ("spelling.lexical.eolmakeum", "error", "default", "safe", [("얼만큼", "얼마큼")]),
    ("spelling.lexical.osundosun", "error", "default", "safe", [("오손도손", "오순도순")]),
    ("spelling.lexical.ukyeoneohda", "error", "default", "safe", [("우겨넣다", "욱여넣다")]),
    ("spelling.lexical.chireotda", "error", "default", "safe", [("치뤘다", "치렀다")]),
    ("spelling.lexical.damgatda", "error", "default", "safe", [("담궜다", "담갔다")]),
    ("spelling.lexical.jamgatda", "error", "default", "safe", [("잠궜다", "잠갔다")]),
    ("spelling.lexical.kkeorimchikhada", "error", "default", "safe", [("꺼림직하다", "꺼림칙하다")]),
    ("spelling.lexical.gaekjjeokda", "error", "default", "safe", [("객적다", "객쩍다")]),
    ("spelling.lexical.silhjeungi-nada", "error", "default", "safe", [("실증이 나다", "싫증이 나다")]),
    ("spelling.lexical.geondeurida", "error", "default", "safe", [("건들이다", "건드리다")]),
    ("spelling.lexical.deulyeodaboda", "error", "default", "safe", [("드려다보다", "들여다보다")]),
    ("spelling.lexical.naerorahada", "error", "default", "safe", [("내노라하다", "내로라하다"), ("내노라하는", "내로라하는")]),
    ("spelling.lexical.deita", "error", "default", "safe", [("데이타", "데이터")]),
    ("spelling.lexical.seolreim", "error", "default", "safe", [("설레임", "설렘")]),
    ("spelling.lexical.barem", "warning", "strict", "review", [("바램", "바람")]),
    ("spelling.lexical.putnaegi", "error", "default", "safe", [("풋나기", "풋내기")]),
    ("spelling.lexical.omeurida", "error", "default", "safe", [("오무리다", "오므리다")]),
    ("spelling.lexical.umkeum", "error", "default", "safe", [("웅큼", "움큼")]),
    ("spelling.lexical.eure", "error", "default", "safe", [("으례", "으레")]),
    ("spelling.lexical.daesup", "error", "default", "safe", [("댓숲", "대숲")]),
    ("spelling.lexical.kkeopjiljjae", "error", "default", "safe", [("껍질채", "껍질째")]),
    ("spelling.lexical.yosae", "error", "default", "safe", [("요세", "요새")]),
    ("spelling.lexical.mirunamu", "error", "default", "safe", [("미류나무", "미루나무")]),
    ("spelling.lexical.matbogi", "error", "default", "safe", [("맛배기", "맛보기")]),
    ("spelling.lexical.napjakhada", "error", "default", "safe", [("납짝하다", "납작하다")]),
    ("spelling.lexical.neolbjeokhada", "error", "default", "safe", [("넙적하다", "넓적하다")]),
    ("spelling.lexical.jjalmakhada", "error", "default", "safe", [("짧막하다", "짤막하다")]),
]

# Literal forms that hold in every profile, anywhere in a text (id, severity, from, to).
FORMS: list[tuple[str, str, str, str]] = [
    ("grammar.negation.ji-anh", "warning", "지 안았다", "지 않았다"),
    ("grammar.negation.an-before-predicate", "warning", "않 간다", "안 간다"),
    ("grammar.particle.duplicate", "warning", "를를", "를"),
    ("grammar.particle.duplicate", "warning", "을을", "을"),
    ("grammar.particle.duplicate", "warning", "은은", "은"),
    ("grammar.particle.duplicate", "warning", "는는", "는"),
    ("spacing.dependent-noun.su", "warning", "할수 있다", "할 수 있다"),
    ("spacing.dependent-noun.su", "warning", "끝낼수", "끝낼 수"),
    ("spacing.dependent-noun.su", "warning", "알수없다", "알 수 없다"),
    ("spacing.dependent-noun.su", "warning", "알수 있다", "알 수 있다"),
    ("spacing.dependent-noun.geot", "warning", "좋을것 같다", "좋을 것 같다"),
    ("spacing.dependent-noun.geot", "warning", "올것 같다", "올 것 같다"),
    ("spacing.dependent-noun.geot", "warning", "될것이다", "될 것이다"),
    ("spacing.dependent-noun.geot", "warning", "할거야", "할 거야"),
    ("spacing.dependent-noun.jeok", "warning", "본적 있다", "본 적 있다"),
    ("spacing.dependent-noun.jeok", "warning", "만난적 있다", "만난 적 있다"),
    ("spacing.dependent-noun.jeok", "warning", "해본적 없다", "해본 적 없다"),
    ("spacing.dependent-noun.jul", "warning", "알줄 안다", "알 줄 안다"),
    ("spacing.dependent-noun.ppun", "warning", "기다릴뿐이다", "기다릴 뿐이다"),
    ("spacing.dependent-noun.ttae", "warning", "만날때", "만날 때"),
    ("spacing.dependent-noun.jung", "warning", "하는중", "하는 중"),
    ("spacing.fixed.su-bakke", "warning", "할 수 밖에", "할 수밖에"),
    ("punctuation.no-space-before-mark", "warning", " .", "."),
    ("punctuation.no-space-before-mark", "warning", " !", "!"),
    ("punctuation.no-space-before-mark", "warning", " ?", "?"),
    ("repetition.ending", "info", "했습니다습니다", "했습니다"),
]

# Rules with conditions (id, least profile, fix safety, confidence, example, its correction).
CONDITIONAL: list[tuple[str, str, str, str, str, str]] = [
    ("grammar.copula.anieyo", "default", "safe", "high", "아니예요", "아니에요"),
    ("grammar.conjugation.doe-to-dwae", "default", "safe", "high", "됀", "된"),
    ("grammar.conjugation.dwae-to-doe", "default", "safe", "high", "돼게", "되게"),
    ("grammar.ending.colloquial-yong", "editorial", "review", "medium", "감사해용", "감사해요"),
    ("grammar.ending.deun-choice", "default", "safe", "high", "커피던지 차던지", "커피든지 차든지"),
    ("grammar.ending.euryeo", "default", "safe", "high", "먹을려고", "먹으려고"),
    ("grammar.ending.euryeo-context", "strict", "review", "medium", "갈려고", "가려고"),
    ("grammar.ending.seumnida", "default", "safe", "high", "읽읍니다", "읽습니다"),
    ("grammar.ending.sipsio", "default", "safe", "high", "확인하십시요", "확인하십시오"),
    ("grammar.negation.anh-doe", "default", "safe", "high", "않됩니다", "안 됩니다"),
    ("grammar.particle.topic-allomorph", "strict", "review", "high", "책는", "책은"),
    ("grammar.particle.subject-allomorph", "strict", "review", "high", "나무이", "나무가"),
    ("grammar.particle.object-allomorph", "strict", "review", "high", "책를", "책을"),
    ("grammar.particle.comitative-allomorph", "strict", "review", "high", "책와", "책과"),
    ("grammar.particle.instrumental-allomorph", "strict", "review", "high", "책로", "책으로"),
    ("punctuation.space-after-comma", "default", "safe", "high", "사과,배", "사과, 배"),
    ("punctuation.space-after-sentence-mark", "default", "safe", "high", "끝났다.다음", "끝났다. 다음"),
    ("repetition.adjacent-word", "default", "review", "medium", "문서를 문서를", "문서를"),
    ("spacing.dependent-noun.beop", "default", "review", "medium", "사는법이다", "사는 법이다"),
    ("spacing.dependent-noun.chae", "default", "review", "medium", "입은채로", "입은 채로"),
    ("spacing.dependent-noun.daero", "default", "review", "medium", "들은대로", "들은 대로"),
    ("spacing.dependent-noun.de", "default", "review", "medium", "묵을데가", "묵을 데가"),
    ("spacing.dependent-noun.deut", "default", "review", "medium", "모르는듯하다", "모르는 듯하다"),
    ("spacing.dependent-noun.mankeum", "default", "review", "medium", "먹을만큼", "먹을 만큼"),
    ("spacing.dependent-noun.ri", "default", "review", "medium", "잊을리가 없다", "잊을 리가 없다"),
]
