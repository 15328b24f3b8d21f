"""What must be equal for equal results. Patterns are in the Java dialect."""

# White space as Unicode has it, and the byte-order mark.
BLANK_CLASS = "[\\s\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"

# Province code, name, pattern.
PROVINCES = [
    ("11", "서울특별시", "서울"),
    ("26", "부산광역시", "부산"),
    ("27", "대구광역시", "대구"),
    ("28", "인천광역시", "인천"),
    ("29", "광주광역시", "광주"),
    ("30", "대전광역시", "대전"),
    ("31", "울산광역시", "울산"),
    ("36", "세종특별자치시", "세종"),
    ("41", "경기도", "경기"),
    ("43", "충청북도", "충청북도|충북"),
    ("44", "충청남도", "충청남도|충남"),
    ("46", "전라남도", "전라남도|전남"),
    ("47", "경상북도", "경상북도|경북"),
    ("48", "경상남도", "경상남도|경남"),
    ("50", "제주특별자치도", "제주"),
    ("51", "강원특별자치도", "강원"),
    ("52", "전북특별자치도", "전북|전라북도"),
]
NATIONWIDE = "전국(?=\\z|[\\s,./]|청년|민|단위|거주|대상|일원)"

# The districts of the capital.
DISTRICTS = [
    "종로구", "중구", "용산구", "성동구", "광진구", "동대문구", "중랑구", "성북구", "강북구", "도봉구", "노원구", "은평구", "서대문구",
    "마포구", "양천구", "강서구", "구로구", "금천구", "영등포구", "동작구", "관악구", "서초구", "강남구", "송파구", "강동구",
]

# Titles about mental health.
MENTAL_STRONG = "마음\\s*건강|정신\\s*건강|심리\\s*(상담|지원|치료|검사|정서)|자살\\s*예방|은둔\\s*형?\\s*청년|고립\\s*청년"
MENTAL_TERM = "심리|정신|마음|정서|우울|불안|스트레스|자살|고립|은둔"

# Document notices without content.
NO_DOCUMENTS = "^(해당없음|없음|해당사항없음|별도공지|추후공지|추후안내|미정)\\z"
DOCUMENT_NOUN = "서류|증명|등본|초본|신청서|동의서|확인서|통장|사본|증빙|카드|자료"

# Programs that exclude each other, and (target, required before it).
EXCLUSIVE_PROGRAMS = ["youth_allowance", "youth_challenge", "kuk_chwi", "monthly_rent"]
PROGRAM_SEQUENCES = [("kuk_chwi", "youth_challenge")]
BLOCKING_REASONS = [
    "AGE_BELOW_MIN", "AGE_ABOVE_MAX", "INCOME_OVER_LIMIT", "REGION_MISMATCH", "RECRUIT_CLOSED", "DUPLICATE_EXCLUSIVE",
    "PREREQ_NOT_MET",
]
REVIEW_LABELS = {
    "AGE_UNKNOWN": "나이 조건",
    "INCOME_UNKNOWN": "소득 조건",
    "INCOME_PROFILE_MISSING": "소득 조건",
    "REGION_UNKNOWN": "거주 지역",
    "REGION_PROFILE_MISSING": "거주 지역",
    "RECRUIT_UNKNOWN": "모집 시기",
    "PREREQ_UNKNOWN": "사전 조건",
}
REVIEW_TEXTS = {
    "age": "나이 조건 — 원문에서 확인",
    "income": "소득 조건 — 원문에서 확인",
    "region": "거주 지역 — 원문에서 확인",
    "recruit": "모집 시기 — 원문에서 확인",
}

# Patterns of the safety screen, in order.
CRISIS_PATTERNS = [
    "죽\\s*고\\s*(싶|시\\s*[퍼포])",
    "죽\\s*는\\s*게\\s*(나|낫)",
    "뒤\\s*지\\s*고\\s*싶",
    "(죽\\s*어|사\\s*라\\s*[져지]|놓\\s*아|놔|끝\\s*내|포\\s*기\\s*[하해]?|지\\s*워)\\s*버\\s*[리릴]",
    "사\\s*라\\s*지\\s*(고|고\\s*싶|져)",
    "없\\s*어\\s*[지져졌]\\s*(고?\\s*싶|야|어?\\s*으?면|으?면)",
    "존\\s*재\\s*하\\s*고?\\s*싶\\s*지?\\s*않",
    "살\\s*고\\s*싶\\s*지\\s*(가\\s*)?않",
    "살\\s*기\\s*(가\\s*)?싫",
    "살\\s*이\\s*유\\s*가?\\s*없",
    "살\\s*아\\s*갈?\\s*자\\s*신\\s*이?\\s*없",
    "사\\s*느\\s*니",
    "사\\s*는\\s*게\\s*(의\\s*미|이\\s*유)\\s*(가\\s*)?없",
    "그\\s*만\\s*살\\s*(고\\s*싶|래)",
    "깨\\s*어\\s*나\\s*고\\s*싶\\s*지\\s*않",
    "(다\\s*시\\s*)?안\\s*깨\\s*어\\s*[나났]",
    "다\\s*시\\s*안\\s*[떴깼]",
    "(못|안)\\s*버\\s*[티틸]",
    "(버\\s*[틸티]|견\\s*[딜디])[^.]{0,6}(힘|기\\s*력|여\\s*력|에\\s*너\\s*지|기\\s*운|의\\s*지)[^.]{0,9}(없|부\\s*족|바\\s*닥|소\\s*진|고\\s*갈|안\\s*남|남\\s*아?\\s*있?\\s*지?\\s*않)",
    "자\\s*살",
    "자\\s*해",
    "목\\s*숨\\s*을?\\s*끊",
    "극\\s*단\\s*적\\s*선\\s*택",
    "유\\s*서\\s*를?\\s*(쓰|썼|남기|작성|적)",
    "끝\\s*내\\s*(고\\s*싶|버\\s*[리릴])",
    "손\\s*목.{0,4}(긋|그\\s*었|그\\s*어|그\\s*을|째|찢)",
    "(약|수\\s*면\\s*제|알\\s*약).{0,8}(다\\s*먹|모\\s*았|모\\s*아|털\\s*어|삼\\s*[켰키킬켜])",
    "다\\s*포\\s*기\\s*하\\s*고?\\s*싶",
    "다\\s*그\\s*만\\s*두\\s*고?\\s*싶",
]
CRISIS_THRESHOLD = 0.82

# Words that name the one domain there is.
DOMAIN_PATTERNS = {
    "mentalHealth": [
        "우\\s*울", "번\\s*아\\s*웃", "무\\s*기\\s*력", "힘\\s*들", "지\\s*쳐|지\\s*친|지\\s*치", "불\\s*안",
        "고\\s*립|은\\s*둔|외\\s*톨\\s*이", "상\\s*담", "마\\s*음\\s*이?\\s*(아|힘|안)", "스\\s*트\\s*레\\s*스",
    ]
}

# Claims that an explanation may not make.
ASSERTIONS = [
    "(적\\s*격|부\\s*적\\s*격|제\\s*외|수\\s*급|수\\s*혜|수\\s*령|선\\s*정|당\\s*첨|탈\\s*락|누\\s*락|포\\s*함|대\\s*상|해\\s*당|자\\s*격)[^.]{0,8}"
    "([됩돼된입]|이\\s*에|예\\s*요|하\\s*셨|했\\s*습|불\\s*가|포\\s*함|제\\s*외|빠\\s*[지진집]|아\\s*[니닌님닙녀]|없|안\\s*[됩돼되]|되\\s*지\\s*않|않\\s*[습아어])",
    "(지\\s*원\\s*)?받\\s*[으을지]?\\s*[실지]?\\s*(수\\s*)?(없|있|못)",
    "못\\s*받|받[^.]{0,3}못\\s*[합한해]",
    "가\\s*능\\s*성\\s*이?\\s*(높|큽|충\\s*분)",
    "확\\s*실\\s*히",
    "반\\s*드\\s*시\\s*(받|지급|선정|가능)",
    "무\\s*조\\s*건",
    "보\\s*장\\s*(합|됩|돼)",
]
REGION_SUFFIX = "(특별자치시|특별자치도|특별시|광역시|시|군|구|도)\\z"
REGION_TOKEN = "([가-힣]{2,3}도|[가-힣]{1,3}(?:특별자치시|특별자치도|특별시|광역시|시|군|구))(?=\\s|\\z|[은는이가을를에의로만도]|[.,!?])"
NUMBER_WITH_UNIT = "(\\d[\\d,]*\\s*(?:만\\s*원|원|만|%|세|명|개월|년))"

# Marks of document lists.
LEADING_NOISE = "^(?:[\\s>\\-–—→▶►▷➤▸○●◎◇◆■□▪▫◦•‣⋅·\\u26A0]|\\uFE0F|\\u200D)+"
SEGMENT_BOUNDARY = (
    "(?:^|(?<=\\s))(?:[0-9]{1,2}\\.(?=\\s)"
    "|[\\u2460-\\u2473](?=[\\s가-힣A-Za-z0-9\\u2460-\\u2473(（])"
    "|[*※☞]"
    "|[\\[\\uFF3B][^\\]\\uFF3D\\r\\n]{1,24}[\\]\\uFF3D]"
    "|[（(][^)）\\r\\n]{0,15}(?:제출|업로드)[)）]"
    "|[-–—]\\s*(?:온라인)?발급처"
    "|[-–—]\\s*[（(](?:필수|선택)[)）]"
    "|[○●◎◇◆■□▪▫◦•‣⋅▶►▷➤]\\uFE0F?(?=[\\s가-힣A-Za-z0-9])"
    "|ㅇ(?=[가-힣]))"
)
MEANINGFUL = "[가-힣0-9A-Za-z①-⑳]"

# Category words and the tag they give, in order.
CATEGORY_TAGS = [
    ("마음|심리|정신|상담", "mind"),
    ("일자리|취업|창업|고용", "work"),
    ("주거|월세|주택", "housing"),
    ("교육|학자금|장학|자격", "education"),
    ("금융|생활|복지|문화", "living"),
]

# Documents that applications ask for: id, name, issuer, fee, minutes.
DOCUMENTS = [
    ("resident_copy", "주민등록등본", "정부24", 0, 5),
    ("resident_abstract", "주민등록초본", "정부24", 0, 5),
    ("income_cert", "소득금액증명", "홈택스(국세청)", 0, 10),
    ("family_relation", "가족관계증명서", "전자가족관계등록시스템(대법원)", 0, 5),
    ("health_insurance_status", "건강보험자격득실확인서", "국민건강보험공단", 0, 5),
    ("health_insurance_fee", "건강보험료 납부확인서", "국민건강보험공단", 0, 5),
    ("basic_cert", "기본증명서", "전자가족관계등록시스템(대법원)", 0, 5),
    ("employment_cert", "재직증명서", "재직 회사", None, None),
    ("enrollment_cert", "재학증명서", "재학 학교", None, None),
    ("local_tax_payment", "지방세 납세증명서", "정부24", 0, 5),
]
ORIGINS = {"ontong": "온통청년", "seoul-youth": "청년몽땅"}

# Texts shown where no grounded explanation is at hand.
FALLBACK_TITLED = " 정책과 관련이 있어 보여요. 자세한 자격 조건은 원문에서 확인해 주세요. (추정)"
FALLBACK_PLAIN = "입력하신 상황과 관련된 정책으로 추정돼요. 원문에서 자격 조건을 확인해 주세요."

# Enumerations of the structured output.
HOUSEHOLD_STATES = ["required", "not_required"]
DUPLICATE_STATES = ["allowed", "disallowed"]
INCOME_KINDS = ["none", "medianRatio", "amountMax"]
