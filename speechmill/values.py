"""Fixed values.

Word lists, lookup tables, labels and patterns that must be equal to those of the source material
for the results to agree. Everything here can be replaced by a parameter of the operator using it.
"""

# --- fixed values: labels ---------------------------------------------------------------------

NO_PARTY = "미분류"
OTHER_AREA = "기타"
UNKNOWN = "unknown"
CHAIR = "위원장"

# --- fixed values: patterns -------------------------------------------------------------------

KOREAN_DATE = r"(\d{4})년\s*(\d{1,2})월\s*(\d{1,2})일"
SESSION_NAME = r"제(\d+)회"
HANGUL_WORD = r"[가-힣]{2,}"

PROCEDURAL_PATTERNS = [
    r"의석을 정돈해 주시기 바랍니다",
    r"성원이 되었으므로",
    r"바쁘신 와중에도.*감사의 말씀",
    r"오늘 회의는.*위해 열렸습니다",
    r"고맙습니다|감사합니다",
    r"다음은.*말씀해 주십시오",
    r"안녕하십니까\?",
]

HTML_ENTITIES = {
    "&nbsp;": " ",
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&middot;": "·",
    "&copy;": "©",
    "&amp;": "&",
}

# --- fixed values: ordinals -------------------------------------------------------------------

IMPORTANCE = {"높음": 3, "중간": 2, "낮음": 1}
STANCE = {"지지": 2, "중립": 1, "반대": -1, "비판적": -2, "건의적": 1, "지지적": 2}

# --- fixed values: speaker to party -----------------------------------------------------------

PARTY_OF_SPEAKER = {
    "신정훈": "더불어민주당",
    "윤건영": "더불어민주당",
    "서범수": "국민의힘",
    "권칠승": "더불어민주당",
    "김성회": "더불어민주당",
    "모경종": "더불어민주당",
    "박정현": "더불어민주당",
    "양부남": "더불어민주당",
    "위성곤": "더불어민주당",
    "이광희": "더불어민주당",
    "이상식": "더불어민주당",
    "이해식": "더불어민주당",
    "채현일": "더불어민주당",
    "한병도": "더불어민주당",
    "고동진": "국민의힘",
    "박덕흠": "국민의힘",
    "박수민": "국민의힘",
    "이달희": "국민의힘",
    "이성권": "국민의힘",
    "주호영": "국민의힘",
    "정춘생": "조국혁신당",
    "용혜인": "기본소득당",
}

# --- fixed values: policy speech filter -------------------------------------------------------

POLICY_WORDS = [
    "정책", "법안", "예산", "복지", "경제", "안전", "지방", "국민", "사회", "발전",
    "해결", "문제", "과제", "지원", "대책", "방안", "제도", "개선", "강화", "추진",
    "계획", "방향", "목표", "현안", "질의", "감사", "청문회", "인사", "임명",
    "재난", "소방", "경찰", "분권", "지역", "선거", "투표", "기금", "결산",
]

PROCEDURAL_WORDS = [
    "의석을 정돈해", "성원이 되었으므로", "회의를 개최", "회의를 개회",
    "감사의 말씀", "고맙습니다", "다음은", "말씀해 주십시오", "이의 없으십니까",
    "의결하겠습니다", "상정합니다", "안건을 상정", "회의를 마치겠습니다",
    "좋습니다", "네", "예", "아니요", "그렇습니다", "맞습니다",
]

# --- fixed values: conversation cleaning ------------------------------------------------------

FILLER_WORDS = [
    "네", "예", "아", "음", "어", "그", "저", "이",
    "그런데", "그리고", "하지만", "그러면", "그래서", "그런", "이런", "저런",
]

# --- fixed values: question and answer markers ------------------------------------------------

QUESTION_MARKERS = ["질의", "질문", "?", "문의", "묻고 싶", "알고 싶"]
ANSWER_MARKERS = ["답변", "설명", "말씀", "드리", "알려"]

# --- fixed values: labels in retrieval documents ----------------------------------------------

DOCUMENT = {
    "issues": "핵심 이슈 요약:",
    "conflicts": "주요 쟁점:",
    "events": "주요 사건:",
    "parties": " / 참여 정당: ",
    "response": " / 대응 ",
    "agenda": "[안건] ",
    "party": "[정당] ",
    "stance": "[입장] ",
    "key_points": "주요 포인트:",
    "concerns": "우려 사항:",
    "suggestions": "제안 사항:",
    "questioner": "[질문자] ",
    "question": "[질문]",
    "respondent": "[답변자] ",
    "answer": "[답변]",
}

# --- fixed values: labels in text blocks for a language service --------------------------------

PROMPT = {
    "session": "=== 회차 정보 ===",
    "session_name": "회차: ",
    "total": "총 발언 수: ",
    "sampled": "개 (전체의 대표 샘플: ",
    "count_end": "개)",
    "count": "개",
    "agendas": "=== 안건 통계 ===",
    "no_agendas": "안건 정보 없음",
    "parties": "=== 정당별 발언 통계 ===",
    "speeches": "개 발언",
    "samples": "=== 대표 발언 샘플 ===",
    "sample_party": "] 정당: ",
    "sample_speaker": ", 발언자: ",
    "sample_text": "발언: ",
    "agenda": "=== 안건 정보 ===",
    "agenda_name": "안건명: ",
    "party_samples": "=== 정당별 발언 샘플 ===",
    "party": "[정당: ",
    "pairs": "=== 질의-응답 샘플 ===",
    "pair": "[질의-응답 ",
    "questioner": "질문자 (",
    "question": "질문: ",
    "respondent": "답변자 (",
    "answer": "답변: ",
}

# --- fixed values: policy areas (a word listed twice counts twice) ----------------------------

POLICY_AREAS = {
    "안전관리": ["안전", "재난", "소방", "경찰", "사고", "참사", "화재", "안전관리", "재난안전",
             "소방청", "경찰청", "안전사고", "재해", "방재", "구조", "응급", "119", "112",
             "행정안전부", "재난관리", "안전정책", "재난대응", "소방정책", "경찰정책"],
    "지방분권": ["지방", "분권", "지역", "지자체", "지방자치", "균형발전", "지방세", "지역균형",
             "지방분권", "지역발전", "지방정부", "지역경제", "지방공기업", "지방교부세",
             "인구감소지역", "접경지역", "지방자치법", "지역균형발전"],
    "예산결산": ["예산", "결산", "회계", "기금", "재정", "예산안", "결산서", "회계연도",
             "예산집행", "재정지원", "보조금", "지방교부세", "기금관리", "재정정책",
             "예산편성", "예산심의", "예산집행"],
    "인사관리": ["인사", "임명", "청문회", "후보자", "장관", "위원장", "인사혁신", "공무원",
             "임용", "승진", "인사제도", "인사정책", "인사혁신처", "인사청문회",
             "인사청문요청안", "인사혁신처장"],
    "법안심사": ["법안", "법률", "개정", "제정", "심사", "통과", "법률안", "법안심사",
             "입법", "법제", "법령", "법규", "특별조치법안", "특별법안", "일부개정법률안"],
    "국정감사": ["감사", "현안", "질의", "조사", "청문회", "국정조사", "감사원", "감사위원",
             "현안질의", "국정감사", "피해조사", "현안질의"],
    "선거관리": ["선거", "투표", "선거관리", "선관위", "선거제도", "선거법", "공직선거",
             "선거공영제", "선거비용", "중앙선거관리위원회", "국민투표법", "지방선거"],
    "복지정책": ["복지", "복지정책", "복지제도", "복지혜택", "복지서비스", "사회보장",
             "복지국가", "복지예산", "민생회복지원금", "민생회복지원법", "민생"],
    "경제정책": ["경제", "경제정책", "경제성장", "경제발전", "경제지표", "경제지원",
             "경제활성화", "경제회복", "경제활동", "경제적", "경제자유특구"],
}

# --- fixed values: sentiment words (a word listed twice counts twice) -------------------------

SENTIMENT = {
    "positive": ["좋", "긍정", "지지", "찬성", "옳", "바람직", "필요", "중요", "필수",
                 "개선", "발전", "향상", "증가", "확대", "강화", "지원", "투자",
                 "성공", "효과", "성과", "성취", "달성", "실현", "구현"],
    "negative": ["나쁜", "부정", "반대", "반대", "잘못", "문제", "위험", "심각",
                 "악화", "감소", "축소", "약화", "제한", "규제", "억제",
                 "실패", "실망", "우려", "걱정", "불안", "위기", "위협"],
    "neutral": ["검토", "논의", "검토", "검토", "검토", "검토", "검토", "검토",
                "제안", "제안", "제안", "제안", "제안", "제안", "제안", "제안"],
}

CONVERSATION_SENTIMENT = {
    "positive": ["좋", "긍정", "지지", "찬성", "옳", "바람직", "필요", "중요", "필수",
                 "개선", "발전", "향상", "증가", "확대", "강화", "지원", "투자",
                 "성공", "효과", "성과", "성취", "달성", "실현", "구현",
                 "감사", "고맙", "훌륭", "훌륭한", "훌륭하다", "훌륭합니다",
                 "잘", "잘하", "잘하고", "잘했다", "잘했습니다"],
    "negative": ["나쁜", "부정", "반대", "잘못", "문제", "위험", "심각",
                 "악화", "감소", "축소", "약화", "제한", "규제", "억제",
                 "실패", "실망", "우려", "걱정", "불안", "위기", "위협",
                 "안타깝", "안타깝다", "안타깝습니다", "유감", "유감스럽",
                 "부족", "부족하다", "부족합니다", "아쉽", "아쉽다", "아쉽습니다"],
    "neutral": ["검토", "논의", "제안", "질문", "답변", "설명", "이해",
                "확인", "검토하", "논의하", "제안하", "질문하", "답변하",
                "설명하", "이해하", "확인하", "생각", "생각하", "생각합니다"],
}

# --- fixed values: issues ---------------------------------------------------------------------

ISSUES = {
    "이태원참사": ["이태원 참사", "159명", "참사"],
    "부천화재": ["부천", "화재", "사건"],
    "오송참사": ["오송", "지하차도", "14명"],
    "지방소멸": ["지방소멸", "인구감소", "지역균형"],
    "딥페이크": ["딥페이크", "성범죄"],
}
