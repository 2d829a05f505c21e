"""The default language pack: word lists and rules that operators take as parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

# Words that score a sense's tone when the index is built.
TONE_GOOD = (
    "吉", "幸運", "幸せ", "成功", "繁栄", "喜び", "順調", "達成", "利益", "豊か", "昇進", "健康", "平和", "安心", "祝福",
    "満足", "発展", "勝利", "愛情", "良い", "チャンス", "希望", "恵まれ", "上昇", "向上", "実り", "報われ", "尊敬", "信頼",
)
TONE_ILL = (
    "凶", "不吉", "警告", "注意", "不安", "失敗", "病気", "トラブル", "危険", "損失", "悪い", "困難", "裏切り", "別れ",
    "苦し", "災い", "障害", "悩み", "ストレス", "対立", "喪失", "後悔", "孤独", "疲れ", "焦り", "誤解", "妨げ", "悪化",
)
# Words that score a symbol's polarity when texts are read.
READING_GOOD = (
    "吉", "幸運", "幸せ", "成功", "繁栄", "喜び", "順調", "達成", "利益", "豊か", "昇進", "健康", "平和", "安心", "祝福",
    "満足", "発展", "勝利", "良い", "希望", "恵まれ", "報われ",
)
READING_ILL = (
    "凶", "不吉", "警告", "注意", "不安", "失敗", "病気", "トラブル", "危険", "損失", "悪い", "困難", "裏切り", "別れ",
    "苦し", "災い", "悩み", "対立", "喪失", "孤独", "悪意", "死", "不運", "不幸",
)
# Words that make no keyword when senses are ordered.
ORDER_STOP = ("夢", "見", "意味", "兆", "暗示", "象徴", "解釈", "占")
# Words that make no keyword when texts are matched.
MATCH_STOP = (
    "夢", "見", "意味", "兆", "暗示", "象徴", "解釈", "占", "最後", "中", "上", "下", "前", "後", "時", "事", "者", "方",
    "分", "回", "向", "私", "彼", "彼女",
)
MATCH_STOP_LATIN = (
    "the", "and", "you", "your", "for", "with", "from", "into", "that", "this", "dream", "dreams", "dreaming", "about",
    "being", "rüyada", "görmek", "gelir",
)
# Symbols written in kana, and the form that the lexicon has.
KANA_BRIDGE = (
    ("いぬ", "犬"), ("ねこ", "猫"), ("へび", "蛇"), ("くま", "熊"), ("とり", "鳥"), ("そら", "空"), ("くるま", "車"),
    ("おかね", "お金"), ("さかな", "魚"), ("おばけ", "お化け"), ("ゆうれい", "幽霊"), ("ひこうき", "飛行機"),
    ("でんしゃ", "電車"), ("がっこう", "学校"), ("かいだん", "階段"), ("とびら", "扉"), ("まど", "窓"), ("びる", "建物"),
)
# Themes and the words that point to them.
THEMES = {
    "love": ("愛", "恋", "結婚", "恋人", "パートナー", "出会い", "絆", "ロマン", "異性", "縁", "花嫁", "花婿"),
    "work": ("仕事", "職", "キャリア", "昇進", "事業", "努力", "成功", "達成", "目標", "挑戦", "勉強", "試験", "計画"),
    "money": ("お金", "金銭", "財", "富", "利益", "収入", "繁栄", "損失", "貧", "豊か", "宝"),
    "social": ("友人", "友達", "人間関係", "信頼", "仲間", "家族", "敵", "裏切", "嫉妬", "悪意", "援助", "助け", "周囲", "中傷", "親戚"),
    "health": ("健康", "病", "体", "疲れ", "回復", "癒し", "休息", "ストレス", "心配", "不安", "安らぎ", "眠"),
    "change": ("変化", "転機", "移行", "新しい", "始ま", "終わ", "旅", "別れ", "再会", "チャンス", "運命", "知らせ", "扉", "道"),
}
# Symbol groups that mean something together, in order of precedence.
PAIR_RULES = (
    (("水", "海", "泳"), ("犬",)), (("落ち",), ("飛",)), (("蛇",), ("金", "光")), (("追いかけ", "追わ"), ("逃げ",)),
    (("古い家", "古い建物"), ("蛇", "虫", "影")), (("結婚", "指輪", "花嫁"), ("黒", "失く", "失う", "壊れ")), (("空",), ("飛",)),
    (("歯",), ("抜け", "折れ")), (("水", "海", "川"), ("月", "星")), (("死", "亡くな"), ("生", "赤ちゃん", "誕生")),
    (("階段", "登る", "上る"), ("落ち", "降り")), (("雨", "嵐", "雷"), ("家", "屋根")),
)


@dataclass(frozen=True)
class Wording:
    """Sentences of a composed reading; placeholders are filled by column expressions. Ours, and replaceable."""

    intro: str = "From “{scene}” these stand out: {names}."
    intro_plain: str = "These stand out: {names}."
    pair: str = "Together they fall under rule {rule}."
    theme: str = "{theme} ({symbols}): {body}{advice}"
    quote: str = "{term}: “{essence}”. "
    advice: dict = field(default_factory=lambda: {1: "Go ahead.", 0: "Watch for a few days.", -1: "Take care."})
    mood: dict = field(default_factory=lambda: {"pos": "A bright night.", "neg": "A night for caution.", "mixed": "Light and shade.", "neutral": "A quiet night."})
    omen: str = "Keep in mind: {term}."
    none: str = "Nothing in the lexicon answers; name things, people or places."
