"""Word lists of the question classifier."""

from __future__ import annotations

# The words that point to each intent, in order of precedence.
KEYWORDS = {
    "dividend_check": ["배당", "배당금", "유배당", "무배당", "상계", "배당 구조"],
    "coverage_inquiry": ["보장", "보험금", "사망보험금", "지급", "보장항목", "보장내용", "보장범위", "보장 한도", "보장금액"],
    "exclusion_exception": [
        "면책", "보험금 지급 제한", "제외", "예외", "면책사유", "면책기간", "부담보", "지급제한", "고지의무", "알릴 의무", "통지의무",
        "계약 전 알릴 의무", "고지의무 위반", "알릴 의무 위반", "고의", "자해", "심신상실", "자살", "계약 무효",
    ],
    "surrender_value": ["해약", "환급금", "해지", "해약환급금", "해지환급금", "중도해지", "환급률"],
    "discount_eligibility": ["할인", "할인율", "보험료 할인", "할인 조건", "할인 대상", "할인 혜택"],
    "regulation_inquiry": [
        "규제", "법률", "법령", "시행령", "시행규칙", "보험업법", "금소법", "금융소비자보호법", "암관리법", "감독규정", "적용되는 법", "적용되는 규제",
        "관련 법규", "준수", "위반", "제재", "처벌", "과태료", "인가", "허가", "등록 요건", "적합성", "설명의무", "청약철회",
        "보험가격지수", "산출이율", "비교공시", "금지행위",
    ],
    "loan_inquiry": ["대출", "보험계약대출", "약관대출", "대출금", "대출이자", "이자율", "상환", "대출한도", "대출 가능"],
    "premium_waiver": ["납입면제", "보험료 납입 면제", "면제", "납입 면제", "보험료 면제", "납입의무 면제"],
    "policy_comparison": [
        "비교", "차이점", "차이", "다른 점", "비교해", "비교해주세요", "어떤게 더", "어떤 게 더", "뭐가 더", "둘 중", "두 보험", "대비", "versus", "vs",
        "뭐가 다른", "뭐가 다르", "골라야", "어떤 걸", "어떤걸", "1종과 2종", "일반형과", "일반형과 간편",
    ],
    "calculation_inquiry": [
        "계산", "계산식", "산출", "공식", "산출방법", "계산방법", "산출식", "계산 공식", "어떻게 계산", "산정", "산정방법", "어떻게 정해", "계산하나", "산출 기준",
    ],
    "eligibility_inquiry": [
        "가입 조건", "가입조건", "가입 자격", "가입자격", "가입 가능", "가입할 수", "누가 가입", "몇 살까지", "가입 연령", "가입연령", "심사", "심사기준",
        "건강진단", "간편가입", "가입 심사", "가입 제한", "가입 대상", "단체 보험", "단체보험",
    ],
    "rider_inquiry": [
        "특약들", "특약은", "특약 목록", "선택특약", "부가특약", "특별약관", "추가 특약", "특약 보장", "특약 내용", "특약 종류", "지정대리청구", "납입면제특약", "어떤 특약",
    ],
}

# A word of the first list and one of the second decide for an intent, first rule first.
RULES = [
    (["보장", "질병"], ["납입면제형"], "coverage_inquiry"),
    (["특약"], ["내용은", "내용을", "어떤 보장", "보장을 하"], "rider_inquiry"),
    (["어떻게 계산", "어떻게 정해", "계산은"], ["보험금", "사망보험금", "보장", "적용이율", "보장개시일", "보장부분"], "calculation_inquiry"),
    (["해약환급금", "환급금"], ["1종", "2종"], "surrender_value"),
    (["할인"], ["혜택", "가족 할인"], "discount_eligibility"),
    (["보험업", "금지행위"], ["예외"], "regulation_inquiry"),
    (["보험금", "지급"], ["면책", "면책사유", "예외", "제외"], "exclusion_exception"),
    (["보험금", "보장"], ["못 받", "안 받", "못받", "안받", "안 나오", "미지급", "지급 제한", "보장 제외", "보장받지 못"], "exclusion_exception"),
    (["면제", "납입"], ["보험료"], "premium_waiver"),
    (["비교", "차이점", "차이", "둘 중", "골라", "뭐가 더", "어떤 게 더", "어떤게 더"], ["보장", "보험금", "면책", "배당", "할인", "환급", "해약", "보험"], "policy_comparison"),
    (["고지의무", "알릴 의무", "통지의무"], ["위반", "해지", "해제", "거절"], "exclusion_exception"),
    (["가입할 수", "가입 가능", "가입"], ["특약들", "특약은", "특약 목록", "특약 종류", "어떤 특약", "선택특약", "부가특약", "특별약관"], "rider_inquiry"),
    (["환급금", "해약환급금", "보험금", "보험료", "할인", "배당"], ["계산식", "산출 공식", "계산 공식", "산출방법", "계산방법", "산출식"], "calculation_inquiry"),
    (["보험금", "보장", "지급"], ["고의", "자해", "심신상실", "자살", "사기", "범죄"], "exclusion_exception"),
]
# Regulatory terms that calculation words would hide.
REGULATORY = ["보험가격지수", "산출이율", "비교공시"]
STRONG_CALCULATION = ["계산식", "산출 공식", "계산 공식", "산출방법", "계산방법", "산출식", "공식"]
