"""Names and months that entity extraction knows."""

# The names that count as entities.
HEBREW_FIRST = frozenset("""
אדר אביב אביגיל אבי אורן אורי אורית אסף אסתר איתי איתן אילן אילת אלון אלה אלי אמיר אנה בר בן בנימין ברק גל גלי
גיא גיל דן דנה דניאל דפנה דרור הדר הילה זיו זוהר חן חנה טל טלי יאיר יהונתן יהלי יואב יוסף יוני יותם יעל יעקב
ינאי כרמל לי ליאב ליאור ליאת לילי לירן מאיה מור מיה מיכל מירב מירי נועה נועם נטע ניר נמרוד ספיר עומר עמית עינב
פלג צור קרן ראם ראובן רון רונן רועי רחל רינת רם שי שירה שני שרון תמר תומר
""".split())

HEBREW_LAST = frozenset("""
אזולאי אברהם אדרי אוחיון אלוש אלמוג אמסלם ביטון בן-דוד בנימין ברוך גולן גל גרוס דהן דוד הרוש זוהר חביב חזן
חיים טוביה יוסף כהן לוי מזרחי מלכה משה נחום סבג סיטון פרץ פרידמן צדוק קהן רוזן שаль שושן שיר שמיר שמעון
תורג'מן
""".split())

ENGLISH_FIRST = frozenset("""
Aaron Adam Alex Alice Amir Andrew Anna Ben Brian Charles Charlotte Chris Daniel David Diana Edward Elizabeth
Emma Eric Eva George Hannah Henry Jack Jacob James Jane Jennifer Jessica John Jonathan Joseph Joshua Julia
Kate Kevin Laura Lauren Liam Lisa Lucas Luke Mark Mary Matthew Michael Michelle Nathan Nicholas Noah Olivia
Patrick Paul Peter Rachel Robert Ryan Samuel Sarah Sophia Stephen Susan Thomas William
""".split())

ENGLISH_LAST = frozenset("""
Adams Anderson Baker Brown Campbell Carter Clark Collins Davis Edwards Evans Garcia Green Hall Harris Hill
Jackson Johnson Jones King Lee Lewis Martin Martinez Miller Mitchell Moore Morgan Nelson Parker Patel Phillips
Roberts Robinson Rodriguez Scott Smith Taylor Thomas Thompson Turner Walker White Williams Wilson Wright Young
""".split())

# Month names in dates.
ENGLISH_MONTHS = "January February March April May June July August September October November December Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec".split()
HEBREW_MONTHS = "ינואר פברואר מרץ אפריל מאי יוני יולי אוגוסט ספטמבר אוקטובר נובמבר דצמבר".split()
#: Hebrew "in", written as one letter before the month.
HEBREW_IN = "ב"
