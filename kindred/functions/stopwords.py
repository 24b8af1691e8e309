"""English words that cleaning drops by default, by length."""

DEFAULT = frozenset(
    """
a i am an as at be by do he if in is it me my no of on or so to up we all and any are but can did few for get
got had has her him his how its let may nor not off one our out own she the too two was who why yet you also
been both dare does down each from have here hers into just lets like made make more most must need none once
only ours over same some such take than that them then they this took used very were what when whom will with
your about above after again being below could doing every liked likes maybe might other ought quite shall
still their there these those three under until where which while whose would yours almost anyone barely
before during hardly having itself making myself nearly nobody pretty rather really should taking theirs
already anybody because between further getting herself himself letting neither nothing perhaps someone
through actually anything everyone probably scarcely somebody yourself basically everybody ourselves something
everything themselves yourselves
""".split()
)
