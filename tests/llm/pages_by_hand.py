"""Web pages written by hand in several styles, with the main text that a reader would mark."""

PAGES = {
    "weblog": (
        """<!doctype html><html lang=en><head><title>Bread</title><link rel=stylesheet href=a.css><script>window.q=window.q||[];q.push("<p>hello</p>")</script></head>
<body class="home blog"><header class="site-header"><a href="/"><img src=logo.png></a><nav><a href="/about">About</a> <a href="/archive">Archive</a></nav></header>
<main><article class="post"><h1>How I bake  bread</h1><p>It took me <em>years</em> to learn this &mdash; and I still fail.</p><p>First, weigh the flour.<br>Then add water.</p>
<ul><li>500 g flour</li><li>350 g water</ul><p>Wait a night.</article></main><aside class="sidebar"><h3>Recent posts</h3><ul><li><a href=/1>Soup</a><li><a href=/2>Salad</a></ul></aside>
<section id="comments"><h2>2 comments</h2><ol class="comment-list"><li class="comment"><p>Great recipe, thank you!</p></li><li class="comment"><p>Mine burned.</p></li></ol></section>
<footer><p>&copy; 2020 The Baker</p></footer></body></html>""",
        ["How I bake bread", "It took me years to learn this — and I still fail.", "First, weigh the flour. Then add water.", "500 g flour", "350 g water", "Wait a night."],
    ),
    "news": (
        """<html><head><meta charset=utf-8><style>.a{color:red}</style></head><body><div class="cookie-banner"><p>We use cookies to improve this site.</p><button>Accept</button></div>
<div id="page"><div class="masthead"><h2>The Daily Paper</h2></div><ul class="menu"><li><a href="#">World</a></li><li><a href="#">Sport</a></li></ul>
<div class="story-body"><h1>River floods old town</h1><p>Water rose two metres on Monday.</p><div class="advert"><p>Buy our boots today!</p></div><p>&ldquo;We lost the cellar&rdquo;, a resident said.</p>
<blockquote>No one was hurt.</blockquote><p>Repairs will cost &euro;3&nbsp;million.</p></div><div class="related"><h3>More on this</h3><ul><li><a href=x>Dam opened</a></li></ul></div>
<div class="newsletter"><form><label>Your mail</label><input><button>Sign up</button></form></div></div><div class="footer">Imprint and terms</div></body></html>""",
        ["River floods old town", "Water rose two metres on Monday.", "“We lost the cellar”, a resident said.", "No one was hurt.", "Repairs will cost €3 million."],
    ),
    "manual": (
        """<!DOCTYPE html><html><body><nav class="toc"><ol><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li></ol></nav><main role="main"><h1>Tool manual</h1><section><h2>Install</h2>
<p>Run this command first:</p><pre>make install   PREFIX=/usr</pre></section><section><h2>Use</h2><p>If a &lt; b the tool stops.</p><table><tr><th>Option</th><th>Meaning</th></tr><tr><td>-v</td><td>Talks more</td></tr></table></section></main>
<footer class="site-footer">Generated yesterday</footer></body></html>""",
        ["Tool manual", "Install", "Run this command first:", "make install PREFIX=/usr", "Use", "If a < b the tool stops.", "Option", "Meaning", "-v", "Talks more"],
    ),
    "old tables": (
        """<HTML><BODY><TABLE><TR><TD CLASS="nav"><A HREF="a.html">Home</A><BR><A HREF="b.html">Links</A></TD><TD CLASS="content"><H1>My stamps</H1><P>I collect stamps of small islands.<P>The oldest is from 1870.
<CENTER>Below you see it.</CENTER></TD></TR></TABLE><DIV CLASS="copyright">Copyright by me, all rights reserved</DIV></BODY></HTML>""",
        ["My stamps", "I collect stamps of small islands.", "The oldest is from 1870.", "Below you see it."],
    ),
    "german": (
        """<!DOCTYPE html><html lang="de"><head><title>Wandern</title></head><body><div class="header"><span>Bergfreunde</span></div><div class="navigation"><ul><li><a href="/t">Touren</a></li></ul></div>
<article><header><h1>Über den Grat</h1></header><p>Der Weg beginnt am Parkplatz und führt steil nach oben.</p><figure><img src="g.jpg"><figcaption>Blick vom Gipfel</figcaption></figure><p>Für den Abstieg braucht man drei Stunden.</p></article>
<div class="sidebar"><p>Beliebte Touren</p><ul><li><a href="1">See</a></li></ul></div><footer>Impressum</footer></body></html>""",
        ["Über den Grat", "Der Weg beginnt am Parkplatz und führt steil nach oben.", "Blick vom Gipfel", "Für den Abstieg braucht man drei Stunden."],
    ),
    "hidden parts": (
        """<html><body><div id="content"><h1>Opening hours</h1><p>We open at nine.</p><p hidden>Internal note.</p><p style="display: none">Draft.</p><p>We close at six.</p><noscript><p>Enable scripts</p></noscript></div>
<div aria-hidden="true">Loading</div><form class="search-form"><input name=q><button>Go</button></form></body></html>""",
        ["Opening hours", "We open at nine.", "We close at six."],
    ),
    "list article": (
        """<html><body><nav><ul><li><a href=1>One</a></li></ul></nav><article><h1>Three rules</h1><ol><li>Be on time.</li><li>Bring <a href="/tools">your tools</a> with you.</li><li>Clean up.</li></ol><dl><dt>Late</dt><dd>You wait outside.</dd></dl></article>
<div class="share-buttons"><a href=t>Tweet</a> <a href=f>Post</a></div></body></html>""",
        ["Three rules", "Be on time.", "Bring your tools with you.", "Clean up.", "Late", "You wait outside."],
    ),
    "nothing": ("""<html><body><nav><a href=/>Home</a></nav><div class="menu"><ul><li><a href=a>A</a></li><li><a href=b>B</a></li></ul></div><footer>Contact</footer></body></html>""", []),
    "cut off": ("""<html><body><header class="header">Site</header><article><h1>Cut</h1><p>The page ends in the mid""", ["Cut", "The page ends in the mid"]),
    "forum post": (
        """<html><body><div class="topbar"><a href=/>Forum</a></div><div class="post"><h2>Which saw for oak?</h2><div class="post-content"><p>I want to cut oak boards.</p><p>Is a hand saw enough?</p></div></div>
<div class="replies"><div class="reply"><p>Use a table saw.</p></div><div class="reply"><p>A hand saw will do.</p></div></div><div class="ad-slot">Saws, 20 % off</div></body></html>""",
        ["Which saw for oak?", "I want to cut oak boards.", "Is a hand saw enough?"],
    ),
}
