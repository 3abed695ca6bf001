"""Function words that mark running prose in English, German, French and Spanish."""

# The commonest articles, prepositions, pronouns, conjunctions and auxiliaries of each language.
_LISTS = """
the of and to in a is that for it was on are as with be at by from or an this have has had not but they you he she
we his her their its which who what when where been were will would there can more if no so about into than then
der die das den dem des und in zu von mit ist im nicht ein eine einer eines einem einen auf für sich auch als an es
bei aus nach wie wird sind war oder aber so wenn noch nur über vor bis durch sie er wir ich hat haben sein werden
le la les de du des et en un une que qui dans pour par sur pas plus au aux ce cette ces est sont il elle ils elles
on nous vous se sa son ses leur leurs avec ne ou mais comme être a été
el los las y que en un una por con para es del al se lo su sus como más pero no o este esta ha son le ya entre
cuando muy sin sobre también hasta hay donde desde todo nos era ser
"""

STOP_WORDS = frozenset(_LISTS.split())
