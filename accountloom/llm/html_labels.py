"""A small labelled table of text blocks: pages in which every block is marked.

FIXED VALUES: written for this purpose.  ``+`` before a block's text marks main text,
``-`` anything else.
"""

PAGES = (
    """<html><head><title>-t</title></head><body><header><a href="/">-Daily Record</a></header>
    <nav><ul><li><a href="/a">-Home</a></li><li><a href="/b">-World</a></li><li><a href="/c">-Sport</a></li></ul></nav>
    <article><h1>+Council votes to keep the old bridge</h1><p>+The council met on Monday and heard from more than
    forty residents before it voted to keep the bridge open for walkers.</p><p>+Work starts soon.</p>
    <p>+Engineers said that the <a href="/s">northern span</a> needs new bearings, and that the repair will take
    two summers if the river stays low.</p></article><aside><h3>-Most read</h3><ul><li><a href="/1">-Ten tips</a></li>
    </ul></aside><footer>-Copyright Daily Record</footer></body></html>""",
    """<body><div class="cookie-notice"><p>-We use cookies to improve this site and to show you adverts that suit you,
    please accept them all to go on reading.</p></div><div class="menu"><a href="/x">-Start</a> <a href="/y">-Team</a>
    </div><div class="content"><h2>+How to prune roses</h2><p>+Cut just above a bud that faces outwards, at a slight
    angle, and take out the dead wood first.</p><p>+Be bold.</p><blockquote>+A sharp blade heals faster than a dull
    one, as my teacher used to say every spring.</blockquote></div><div id="sidebar"><p>-Sign up for our letter and
    never miss a post about gardens and tools again.</p></div><div class="footer">-Imprint</div></body>""",
    """<body><p><a href="/1">-Index</a> <a href="/2">-Archive</a> <a href="/3">-Links</a></p><h1>+Notes on tides</h1>
    <p>+The moon raises two bulges of water, one on the near side and one on the far side, and the earth turns
    beneath them once a day.</p><p>+The sun does the same with less force, which is why the highest tides come at
    new and full moon when both pull in line.</p><p>+So it goes.</p><p><a href="/n">-next page</a></p>
    <p>-(c) 2019</p></body>""",
    """<body><main><h1>+Release 4.2</h1><ul><li>+Faster start of large projects</li><li>+Fixed a crash when a file
    was renamed during a search</li></ul><div class="ad">-Buy two, get one free, only this week in all our shops and
    online while stocks last.</div><p>+Thanks to everybody who reported problems in the last months.</p>
    <form><label>-Your mail</label><p>-Subscribe to the list and get a message for every new version we make.</p>
    </form></main><section id="comments"><h3>-Comments</h3><p>-Great work, I have waited for this for a long time and
    it runs well here!</p><p>-Thanks</p></section></body>""",
    """<body><div role="navigation"><a href="/p">-Products</a><a href="/q">-Prices</a></div><article><p>+Short one.</p>
    <table><tr><td>+Year</td><td>+Tons</td></tr><tr><td>+1990</td><td>+12</td></tr></table><pre>+a = b + c</pre>
    <div class="share"><a href="/t">-Share this</a></div><div class="related"><p>-You may also like the story of the
    long winter and the broken mill.</p></div></article><div class="advert"><p>-Ad</p></div></body>""",
    """<body><div class="top-banner"><p>-Spring sale ends on Sunday, do not miss our offers for all members.</p></div>
    <div><p>+It was the third day of rain when the letter came, and nobody in the house dared to open it before
    supper.</p><p>+Then Anna took the knife.</p><p>+She read it twice, folded it along the old lines, and put it
    under the clock where the others lay.</p></div><div><a href="/c1">-Chapter one</a> <a href="/c2">-Chapter two</a>
    <a href="/c3">-Chapter three</a></div><footer><p>-All rights reserved, no part of this work may be copied without
    leave of the owner.</p></footer></body>""",
    """<body><div class="wrapper"><article><header><h1>+Sources of the river atlas</h1><p>-By R. Holm</p></header><ul><li>
    <a href="/m">+Map of the upper basin, second edition</a></li><li><a href="/n">+Gauge readings of the last forty
    years</a></li></ul><p><a href="/o">+All tables in one file</a></p><p>+Corrections are welcome.</p><nav>
    <a href="/p">-Previous</a> <a href="/q">-Next</a></nav></article></div></body>""",
    """<body><h1>+Bread without an oven</h1><p>+Mix flour, water, salt and a little yeast, and leave the dough under a
    cloth for an hour or two until it has doubled.</p><p>+Heat a heavy pan with a lid.</p><p>+Bake the loaf over a low
    flame, turn it once, and let it cool on a rack before you cut it, however good it smells.</p><ul><li>
    <a href="/r1">-Soup</a></li><li><a href="/r2">-Salad</a></li><li><a href="/r3">-Sauces</a></li></ul></body>""",
    """<html><body><article><h1>+Moss</h1><p>+It grows on stone.</p><p>+End</p></article></body></html>""",
    """<article><p>+One</p><p>+Two words</p></article>""",
    """<body><h1>+A letter home</h1><p>+Dear all, the ship reached the harbour on Tuesday after nine days of fog, and
    we slept on land for the first time since May.</p><p>+The captain sends his regards and asks for more of the
    plum jam, which did not last past the first week.</p><p>+Yours, Ida</p></body>""",
    """<main><h2>+Opening hours</h2><p>+We are open from nine to five on all working days, and from ten to two on the
    first Saturday of the month.</p><p>+Closed today</p></main><footer><p>-Imprint</p><p>-Contact</p></footer>""",
    """<body><div class="content-sidebar-wrap"><h1>+Salt pans of the coast</h1><p>+The sea is let into shallow basins in
    April, and the sun takes the water away until a white crust can be raked together.</p><p>+Three families still
    work there.</p><div class="sidebar"><p>-Sign up now and read every story of the coast before all others do.</p>
    <a href="/1">-Older</a></div></div><div class="footer-content"><a href="/i">-Imprint</a></div></body>""",
    """<body><div class="main has-sidebar"><p>+The old ferry runs twice a day while the ice allows it, and the crew rings
    a bell before it leaves the pier.</p><p>+Bring coins.</p></div><div id="sidebar"><p>-Our partners offer cheap rooms
    with a view of the lake for guests who book early.</p></div></body>""",
    """<body><article class="post comments-open"><h2>+A kite of paper</h2><p>+Fold the sheet along both diagonals and glue
    two thin sticks across it before you tie the line.</p><p>+Wait for wind.</p><div id="comments"><div
    class="comment-body"><p>-Mine flew for an hour and then it was lost in the neighbour's tree for good.</p></div>
    </div></article></body>""",
)
