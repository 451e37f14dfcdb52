"""Fixed vocabulary: labels, word lists, thresholds and messages.

Everything here is data.  The operators take these values as parameters, so another
catalog can bring its own; the defaults below describe a car catalog.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------- fixed values: energy classes
# (keywords, class) in evaluation order.  "非插电式混合" contains "插电式混合", so it has to be
# tested before the plug-in rule to be classed as a non-plug-in hybrid.
ENERGY_RULES = (
    (("非插电式混合",), "混动"),
    (("插电式混合", "插混", "phev"), "插混"),
    (("增程",), "增程"),
    (("纯电",), "纯电"),
    (("油电混合", "轻混", "电驱", "hev"), "混动"),
    (("汽油", "柴油", "cng", "天然气", "燃油"), "燃油"),
)
# The same rules with the plug-in test first: non-plug-in hybrids then land in 插混.
ENERGY_RULES_PLUG_IN_FIRST = (
    (("插电式混合", "插混", "phev"), "插混"),
    (("增程",), "增程"),
    (("纯电",), "纯电"),
    (("油电混合", "非插电式混合", "轻混", "电驱", "hev"), "混动"),
    (("汽油", "柴油", "cng", "天然气", "燃油"), "燃油"),
)
ENERGY_CLASSES = ("燃油", "纯电", "插混", "增程", "混动")
HYBRID_CLASSES = ("插混", "增程", "混动")
PURE_ELECTRIC = "纯电"
COMBUSTION = "燃油"

# ---------------------------------------------------------------- fixed values: body classes
# (source column, pattern, class) in evaluation order; no match leaves the trimmed structure text.
BODY_RULES = (
    ("level", "SUV", "SUV"),
    ("level", "MPV", "MPV"),
    ("level", "跑车", "跑车"),
    ("level", "轻客", "轻客"),
    ("structure", "两厢", "两厢车"),
    ("level", "微型车|小型车|紧凑型车|中型车|中大型车|大型车", "轿车"),
)
FAMILY_BODIES = ("SUV", "MPV")
BLANK_MARKS = ("", "-", "--")
ABSENT_MARKS = ("-", "--")

# ---------------------------------------------------------------- fixed values: listing categories
BODY_CATEGORY_LIMITS = {
    "微型车": 100_000, "小型车": 100_000, "紧凑型车": 100_000, "中型车": 100_000, "中大型车": 100_000,
    "大型车": 100_000, "跑车": 100_000, "SUV": 100_000, "MPV": 100_000,
}
ENERGY_CATEGORY_LIMITS = {
    "纯电动车": 100_000, "插电式混合电动车": 100_000, "非插电式混合电动车": 100_000, "增程式电动车": 100_000,
}

# ---------------------------------------------------------------- fixed values: scenario tags
SCENARIO_CITY = "城市通勤"
SCENARIO_FAMILY = "家庭出行"
SCENARIO_LONG = "长途出行"
SCENARIOS = (SCENARIO_CITY, SCENARIO_FAMILY, SCENARIO_LONG)
CITY_FUEL_LIMIT = 8.5
FAMILY_SEATS = 5
LONG_RANGE_KM = 500

# ---------------------------------------------------------------- fixed values: catalog columns
COMPLETENESS_FIELDS = ("seats", "range_km", "fuel_consumption", "horsepower", "model_year", "sales")
COMPLETENESS_BASE = 6
CATALOG_COLUMNS = (
    "car_id", "series_id", "model_name", "brand", "price_min_wan", "price_max_wan", "price_mid_wan",
    "body_type", "energy_type", "seats", "range_km", "fuel_consumption", "horsepower", "model_year",
    "sales", "sales_period", "trim_count", "heat_score", "normalized_heat", "scenario_tags",
    "data_completeness", "source", "source_url", "options_url", "sales_url", "updated_at",
)
PUBLIC_FIELDS = (
    "car_id", "model_name", "brand", "price_min_wan", "price_max_wan", "body_type", "energy_type",
    "seats", "range_km", "fuel_consumption", "horsepower", "model_year", "sales", "sales_period",
    "normalized_heat", "data_completeness",
)
OTHER_LABEL = "其他"
UNKNOWN_LABEL = "未知"

# ---------------------------------------------------------------- fixed values: named attributes
PARAM_BRAND = "厂商"
PARAM_LEVEL = "级别"
PARAM_PRICE = "厂商指导价(元)"
PARAM_FUEL = "工信部综合油耗(L)"
PARAM_POWER = "最大马力(Ps)"
LEAKAGE_PARAMETERS = ("全国4S最低报价", "车款人气")
CONTROL_ONLY_PARAMETERS = (PARAM_PRICE,)
CATEGORICAL_CONTROLS = ("brand", "level_name", "energy_type", "body_structure")
NUMERIC_CONTROLS = ("price_median_wan", "model_year_max", "trim_count")
CONTROL_LABELS = {
    "brand": "品牌",
    "level_name": "级别",
    "energy_type": "能源类型",
    "body_structure": "车身结构",
    "price_median_wan": "指导价格",
    "model_year_max": "车型年份",
    "trim_count": "车款数量",
}
EQUIPMENT_CODES = {"standard": 1.0, "optional": 0.5, "mixed": 0.75}
MIN_NUMERIC_ROWS = 20
MIN_TYPE_RATIO = 0.5

# ---------------------------------------------------------------- fixed values: request rules
WEIGHTS = {"price": 0.35, "body_type": 0.20, "energy_type": 0.20, "scenario": 0.15, "brand": 0.05, "heat": 0.05}
LIMIT_DEFAULT, LIMIT_MIN, LIMIT_MAX = 5, 3, 5
SEATS_MIN, SEATS_MAX = 2, 9
LABEL_PRICE_MIDDLE = "价格位于预算中段"
LABEL_PRICE_INSIDE = "价格处于预算范围内"
LABEL_PRICE_RELAXED = "价格在放宽后的预算范围内"
LABEL_BRAND = "符合品牌偏好"
LABEL_HEAT = "热度表现较好"
RELAXED_BRAND = "品牌偏好（候选不足 3 款）"
RELAXED_SCENARIO = "使用场景（候选不足 3 款）"
RELAXED_BUDGET = "预算上限放宽 10%% 至 %.2f 万元"
ERROR_MESSAGES = {
    "json": ("INVALID_JSON", "请求体必须是 JSON 对象"),
    "budget_order": ("INVALID_BUDGET", "预算下限不能高于预算上限"),
    "brands": ("INVALID_BRANDS", "品牌偏好必须是字符串数组"),
    "limit": ("INVALID_LIMIT", "推荐数量必须是 3—5"),
    "seats_integer": ("INVALID_SEATS", "最低座位数必须是整数"),
    "seats_range": ("INVALID_SEATS", "最低座位数必须在 2—9 之间"),
    "sales": ("INVALID_SALES", "最低月销量必须是非负整数"),
    "scenario": ("INVALID_SCENARIO", "不支持该使用场景"),
    "compare_count": ("INVALID_COMPARE_COUNT", "请选择 2—3 款车型进行对比"),
    "compare_duplicate": ("DUPLICATE_CAR", "对比车型不能重复"),
    "overview_limit": ("INVALID_LIMIT", "limit 必须是 1 到 500 之间的整数"),
}
BUDGET_LABELS = {"budget_min_wan": "预算下限", "budget_max_wan": "预算上限"}

# ---------------------------------------------------------------- fixed values: comparison
RADAR_DIMENSIONS = ("价格优势", "动力水平", "座位空间", "车型新鲜度", "市场热度", "数据完整度")
COMPARISON_ATTRIBUTES = (
    ("车型", "model_name"), ("品牌", "brand"), ("参考价格", "price_min_wan"), ("车身类型", "body_type"),
    ("能源类型", "energy_type"), ("月销量", "sales"), ("销量周期", "sales_period"), ("座位数", "seats"),
    ("续航", "range_km"), ("标注功率", "horsepower"), ("车型年款", "model_year"), ("数据完整度", "data_completeness"),
)

# ---------------------------------------------------------------- fixed values: evidence
TREND_STATUS = "insufficient_history"
TREND_REASON = "仅有单期配置快照，不能估计配置渗透趋势或预测未来趋势"
TREND_REASON_DEFAULT = "仅有单期配置快照，暂不输出未来趋势判断"
INTERPRETATION = "探索性关联，不代表配置参数对销量的因果影响"
IMPORTANCE_NOTES = {
    "elastic_net_coefficient": "基于方差缩放特征的全样本拟合系数，用于方向参考",
    "random_forest_importance": "全样本拟合的结点不纯度重要度，仅用于补充排序，不参与证据等级",
}
METRIC_LABELS = {
    "baseline_elastic_net": "控制变量基线",
    "full_elastic_net": "Elastic Net（含配置参数）",
    "full_random_forest": "随机森林（含配置参数）",
}
STRENGTH_LABELS = {"strong": "强证据", "moderate": "中等证据", "weak": "弱证据", "not_evaluated": "未评估"}
DIRECTION_LABELS = {"positive": "正向", "negative": "负向", "mixed": "方向混合", "neutral": "中性", "not_evaluated": ""}
WARNING_MISSING = "分析结果文件缺失："
WARNING_UNREADABLE = "分析结果文件无法读取："


@dataclass(frozen=True)
class SiteLinks:
    """URL templates of the site a catalog was taken from; ``{id}`` is replaced by the key."""

    series: str = "https://catalog.example/{id}/"
    options: str = "https://catalog.example/{id}/options/"
    sales: str = "https://catalog.example/sales/{id}/"
    trim: str = "https://catalog.example/trim/{id}/options/"
    series_link_pattern: str = r"https?://[^/]+/(\d+)/"
    price_link_mark: str = "/price/"
    source_label: str = "public catalog"


@dataclass(frozen=True)
class RelaxPolicy:
    """Fewer than ``minimum`` candidates open a condition; the ceiling grows by ``ceiling_factor``."""

    minimum: int = 3
    ceiling_factor: float = 1.10


@dataclass(frozen=True)
class CatalogRules:
    """All rule tables of the cleaning job."""

    energy_rules: tuple = ENERGY_RULES
    body_rules: tuple = BODY_RULES
    classes: tuple = ENERGY_CLASSES
    blank_marks: tuple = BLANK_MARKS
    links: SiteLinks = field(default_factory=SiteLinks)
