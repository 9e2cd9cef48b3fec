"""Exclusion vocabularies and query hints. All are defaults, never required."""

from __future__ import annotations

# Results depend on them as they are.

#: Each exclusion with the surface forms that count towards it.
SURFACE_FORMS: dict[str, tuple[str, ...]] = {
    "系统": ("系统", "任务奖励"),
    "穿越": ("穿越", "异世界"),
    "重生": ("重生",),
    "修仙": ("修仙", "筑基", "金丹", "元婴", "渡劫", "灵根", "仙门"),
    "修真": ("修真", "筑基", "金丹", "元婴", "渡劫", "灵根"),
    "恋爱": ("恋爱",),
    "机甲": ("机甲", "驾驶舱"),
    "直播": ("直播", "弹幕", "主播"),
    "校园": ("校园", "班主任", "高考", "学长"),
    "异能": ("异能", "能力者", "异能者", "超能力"),
    "僵尸": ("僵尸", "尸毒", "养尸", "尸王"),
    "变身": ("变身",),
    "兽人": ("兽人", "半兽", "兽族"),
}
#: Labels that readers give a book and that its text need not hold; only a model can judge them.
READER_LABELS: tuple[str, ...] = (
    "后宫", "宫斗", "种马", "争霸", "玄幻", "灵异", "超能力", "言情", "恋爱脑",
    "宠文", "圣母", "玛丽苏", "金手指", "魔改", "克苏鲁", "打脸", "虐主",
    "爽文", "无脑", "小白", "狗血", "开挂", "开局无敌", "速通", "独狼", "压抑", "搞笑",
)
NEGATIONS = ("不要", "避免", "不", "别", "无", "非")
SYNTHESIS_NEGATIONS = ("不要", "不想", "不含", "不", "别", "无", "非")
PROTAGONIST = "主角"
#: Words that a preference's term brings into a search.
HINTS: dict[str, tuple[str, ...]] = {
    "凡人流": ("韩立式", "凡人修仙", "普通资质", "草根修仙", "谨慎", "低调", "炼气", "筑基", "宗门", "散修", "资源争夺"),
    "仙侠": ("修仙", "灵根", "法宝", "丹药", "金丹", "元婴", "飞升", "宗门"),
    "慢热": ("慢热成长", "稳扎稳打", "苦修", "逐步升级"),
    "理性主角": ("谨慎", "冷静", "低调", "克制", "计算"),
    "理性": ("谨慎", "冷静", "低调", "克制", "计算"),
    "主角": ("主角",),
    "不系统": ("无系统", "无面板", "无任务奖励"),
    "系统": ("无系统", "无面板", "无任务奖励"),
}
#: Marks of a source in a profile.
PROFILE_MARKS = ("知轩藏书", "zxcs", "www.zxcs", "精校小说下载", "更多精校小说")

# End of the fixed values.

COUNTED_FORMS: tuple[str, ...] = tuple(sorted({form for forms in SURFACE_FORMS.values() for form in forms}))
