"""Vocabularies that results depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Press types with label, order of display and channels.
PRESS_TYPES: list[tuple[str, str, tuple[str, ...]]] = [
    ("press_release", "보도자료", ("korea_policy_briefing_press_release", "fss_press_release", "ksd_press_release", "bok_press_release")),
    ("press_explainer", "보도설명자료", ("fss_press_explainer", "fsc_press_explainer")),
    ("rule_change_notice", "규정 제개정 예고", ("fsc_rule_change_notice", "ksd_rule_change_notice", "krx_rule_change_notice", "kofia_rule_change_notice")),
    ("recent_rule_change_info", "최신 제·개정 정보", ("fsc_regulation_notice", "krx_recent_rule_change", "kofia_recent_rule_change")),
    ("admin_guidance_notice", "행정지도 예고", ("fsc_admin_guidance_notice", "fss_admin_guidance_notice")),
    ("admin_guidance_enforcement", "행정지도 시행", ("fsc_admin_guidance_enforcement", "fss_admin_guidance_enforcement")),
    ("law_interpretation", "법령해석", ("fsc_law_interpretation",)),
    ("no_action_opinion", "비조치의견서", ("fsc_no_action_opinion",)),
    ("other_data", "기타자료", ("kfb_publicdata_other", "fsec_bbs_222")),
]
# Organisation names by channel prefix.
ORGANIZATIONS = {"bok": "한국은행", "fsc": "금융위원회", "fss": "금융감독원", "ksd": "한국예탁결제원", "krx": "한국거래소", "kofia": "금융투자협회", "kfb": "전국은행연합회", "fsec": "금융보안원"}
CANONICAL_CHANNELS = (
    "bok_press_release fsc_press_explainer fsc_rule_change_notice fsc_regulation_notice fsc_admin_guidance_notice fsc_admin_guidance_enforcement "
    "fsc_law_interpretation fsc_no_action_opinion fss_press_release fss_press_explainer fss_admin_guidance_notice fss_admin_guidance_enforcement "
    "ksd_press_release ksd_rule_change_notice krx_recent_rule_change krx_rule_change_notice kofia_recent_rule_change kofia_rule_change_notice "
    "kfb_publicdata_other fsec_bbs_222"
).split()
# Order of preference of file formats, for attachments and for rule files.
ATTACHMENT_FORMATS = ("pdf", "hwpx", "hwp", "docx", "doc", "xlsx", "xls", "pptx", "ppt", "txt", "zip")
RULE_FORMATS = ("hwpx", "hwp", "pdf", "docx", "xlsx", "xls", "md", "txt")
# Channels and systems of general news.
NEWS_CHANNELS = ("arirang_news_api", "overseas_news_api")
# Stop words of the tokenizers.
NEWS_STOPWORDS = (
    "보도자료 보도 자료 관련 안내 공지 대한 위한 및 등 기자 뉴스 정부 경제 정책 지원 추진 운영 개선 발표 기준 계획 최근 주요 대한민국 한국 금융 위원회 원 기사 속보"
).split()
WEAK_TERMS = "금융 투자 업무 시장 경제 활성화 지원 관리 간담회 정책 제도 사업 발표 개최 강화 추진 위원장 기관 정부".split()
TITLE_STOPWORDS = "보도자료 보도 자료 관련 안내 공지 및 등".split()
RULE_STOPWORDS = "행정지도 예고 시행 관련 업무 기준 규정 지침 세칙 개정 사항 금융 금융위원회 금융감독원 그리고 또는 대한 관한 위한 통해 부터 까지 은행".split()
APPROVAL_TERMS = "폐지 승인 인가 등록 취소 정지 공고 행정예고 조치".split()
COMPANY_ENDINGS = ("주식회사", "㈜", "주", "유한회사", "유한", "법인")
COMPANY_MARKS = ("홀딩스", "자산운용")
# Particles that end a Korean word.
PARTICLES = "은 는 이 가 을 를 의 로 에서 와 과 도 만 서 에 로서 으로 면 주는 에서는 에게 을로 으로서 의에서 을도 를도".split()


def channels_of(press_type: str) -> tuple[str, ...]:
    return next((channels for key, _, channels in PRESS_TYPES if key == press_type), ())


def press_type(channel: Column) -> Column:
    """Key of the press type of a channel; unknown and null channels are press releases."""
    out = F
    for key, _, channels in PRESS_TYPES:
        out = out.when(channel.isin(*channels), key)
    return out.otherwise(PRESS_TYPES[0][0])


def press_label(key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for k, label, _ in PRESS_TYPES for x in (k, label)])
    return F.coalesce(F.try_element_at(table, key), key)


def press_order(key: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k, _, _ in PRESS_TYPES]), key).cast("int")


def canonical_organization(channel: Column, organization: Column) -> Column:
    table = F.create_map(*[F.lit(x) for c in CANONICAL_CHANNELS for x in (c, ORGANIZATIONS[c.split("_")[0]])])
    return F.coalesce(F.try_element_at(table, channel), organization)


def format_rank(ext: Column, formats: tuple[str, ...] = ATTACHMENT_FORMATS) -> Column:
    """1 for the preferred format, 99 for one that is not listed."""
    at = F.array_position(F.array(*[F.lit(x) for x in formats]), F.regexp_replace(F.lower(F.trim(ext)), r"^\.+", "")).cast("int")
    return F.when(F.coalesce(at, F.lit(0)) > 0, at).otherwise(99)
