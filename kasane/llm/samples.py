"""Labelled sentences the residue classifier is fitted on (fixed values; their number is the documented bound).

RESIDUE stands in place of content: script notices, error pages, refusals,
waiting notes, traces, filler. ORDINARY speaks about such things, or about
anything else, in sentences of its own. SLOT_NAMES are names of form fields.
"""

RESIDUE = """
JavaScript is required to view this page.
This site requires JavaScript to function properly.
Please turn JavaScript on and reload the page.
You need to enable JavaScript to run this app.
JavaScript seems to be disabled in your browser.
JavaScript is turned off; the list cannot be drawn.
Your browser does not support JavaScript or has it switched off.
Scripts are blocked on this page, so the content will not load.
Enable scripts and cookies to continue.
Cookies must be enabled in order to use this service.
Allow active content for this site and press reload.
Active content is blocked; this area stays blank until you permit it.
Without scripting this viewer cannot be shown.
Switch scripting on, then press F5 to use this view.
Noscript: this page needs scripts to display its text.
If nothing appears, check whether scripts are allowed.
Loading, please wait...
The page is still loading. If it does not appear, refresh your browser.
Your browser is not supported. Please upgrade to a newer version.
Please enable cookies and reload the page.
Checking your browser before you continue.
Verify that you are human to continue.
Page not found.
404 Not Found
404 - File or directory not found.
The page you requested could not be found.
The page you are looking for does not exist or has been moved.
The requested URL was not found on this server.
We could not find the page you were looking for.
Sorry, this page is no longer available.
This content has been removed or taken down.
The text you asked for is no longer at this address.
The link may be broken or the page may have been moved.
The link you followed has expired.
The document could not be loaded.
The page could not be displayed.
The resource is gone and will not come back.
410 Gone
403 Forbidden
Error 403: Forbidden.
401 Unauthorized
Access denied.
Access to this page is denied.
Access to this section has been refused.
You do not have permission to view this page.
You lack the rights to open this document.
You are not authorized to access this resource.
You have no valid licence for this service.
The server refused your request; the administrator has been informed.
Contact the administrator to be given access.
You must be logged in to view this content.
Please sign in to continue.
Please log in again to view this document.
Sign in again to see the page.
Your session has expired.
Your session has timed out. Please log in again.
Your session has ended.
500 Internal Server Error
Internal server error.
Error 500: internal server error.
502 Bad Gateway
Bad gateway.
503 Service Unavailable
Service temporarily unavailable.
The service is unavailable.
504 Gateway Timeout
The gateway did not answer in time.
The server did not respond in time.
The server is temporarily unable to service your request.
The server encountered an unexpected condition and stopped.
An unexpected error occurred.
An error has occurred while processing your request.
Something went wrong.
Oops! Something went wrong on our end.
Oops, that did not work.
Sorry, we ran into a problem while building this list.
We are having technical difficulties.
Please try again later.
Try again in 5 minutes or contact the help desk.
Please retry in a moment.
Please reload.
Refresh the page and try again.
Too many requests.
You have sent too many requests; slow down.
Too many requests came from your network.
Rate limit exceeded. Please wait and retry.
The request timed out.
Your request could not be completed.
The search returned an error and was stopped.
The site is down for maintenance.
This service is being maintained until 10:00.
We are currently undergoing scheduled maintenance.
Nothing can be shown at the moment.
No results can be displayed right now.
The site is overloaded, please come back later.
Database error: connection lost.
Error establishing a database connection.
Could not connect to the database server.
Connection refused.
Connection reset by peer.
Connection timed out after 30 s.
Upstream server unreachable, stream closed.
[ab12cd] host unreachable, backend closed the stream after 8 s
[1a2b3c] backend did not answer, upstream reset
Query failed: select name from users where id = 5
query : select title from items where code = '' -- retry 2
Traceback (most recent call last):
Traceback: lookup failed at line 12
File "app.py", line 33, in get
KeyError: 'title'
ValueError: invalid literal
TypeError: object is not callable
NullPointerException at line 20
java.lang.IllegalStateException: closed
Uncaught exception in thread main
Unhandled exception: stack trace follows
Fatal error: call to undefined function
Warning: undefined variable on line 7
Syntax error near line 3
Segmentation fault
[object Object]
Permission denied.
No such file or directory.
File not found.
Back to the home page.
That page has gone missing.
Something broke while loading the data.
We hit a snag, give it another go later.
The operation timed out.
The operation failed and was cancelled.
Failed to load resource.
Failed to fetch the page, please retry.
Unable to load this content.
Unable to connect to the host.
This feature needs scripts, which your browser blocks.
This application will not work unless scripts are allowed.
Turn on cookies in the settings of your browser.
The content you want is not available in your region.
Subscribe or log in to read the rest.
Login required.
You have been logged out.
Your account has no access here.
The server is busy.
The system is offline for repairs.
We will be back soon.
Return to the start page.
KeyError: ''
Forbidden
Unauthorized
Oops!
This view cannot be drawn without scripts.
The tree cannot be displayed without it.
noscript: the browser runs no scripts, so the text is not shown.
You have scripting disabled.
Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.
Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.
Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.
Lorem ipsum cillum fugiat aliqua irure velit esse.
Laboris amet tempor nulla magna minim venia dolore.
Aute incidu consec ullamc nostru elitse aliqua.
Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit.
Description goes here.
Title goes here.
Your text here.
Insert your content here.
Add a summary here.
Enter description.
Text to be added.
Content coming soon.
This is dummy text.
This is sample text.
Placeholder text.
This is a placeholder paragraph.
Replace this text with your own content.
Write your text in this space.
Type something here.
Example text for layout only.
Some random text to fill the space.
To be completed.
To be determined.
TBD TBD TBD
sample sample sample
text text text text text
blah blah blah
asdf asdf asdf
test test test test
xxx xxx xxx
qwerty qwerty
1234567890
ダミーテキストです。
ダミー文です。
サンプルテキストです。
サンプル文章です。
仮テキストが入ります。
ここにテキストを入れてください。
この文章は仮のものです。
ページが移動または削除されました。
表示できるデータがありません。
通信に失敗しました。
ご覧になるにはログインが必要です。
ここに説明文が入ります。
ここに本文が入ります。
ここにタイトルを入力してください。
この文章はダミーです。
文章が入ります。
テキストが入ります。
仮の文章です。
テストテストテスト
本文本文本文本文
あああああ
JavaScriptを有効にしてください。
このページを表示するにはJavaScriptが必要です。
JavaScriptがオフのため表示できません。
JavaScriptが無効になっています。
お使いのブラウザはJavaScriptに対応していません。
ご利用のブラウザではスクリプトが動作していません。
スクリプトが無効のため、本文を読み込めません。
スクリプトの実行を許可してください。
本サイトの利用にはクッキーの許可が必要です。
Cookieを有効にしてから再度アクセスしてください。
ブラウザの設定をご確認ください。
設定をご確認のうえ、再読み込みしてください。
読み込み中です。しばらくお待ちください。
読み込みに失敗しました。
表示に失敗しました。
データを取得できませんでした。
ページが見つかりません。
お探しのページは見つかりませんでした。
指定されたページは存在しません。
指定されたURLは存在しないか、移動した可能性があります。
ご指定のページは削除されたか、移動されました。
リンク先が見つかりません。
トップページへお戻りください。
トップページに戻る
アクセスが拒否されました。
アクセス権限がありません。
このページを閲覧する権限がありません。
このデータへのアクセスは許可されていません。
管理者にお問い合わせください。
ログインしてください。
再度ログインしてください。
セッションの有効期限が切れました。
セッションがタイムアウトしました。
エラーが発生しました。
予期しないエラーが発生しました。
内部エラーが発生しました。
内部エラー (500): 読込みに失敗しました。
システムエラー
エラー番号: 500 時間をおいて再度お試しください。
エラーコード 12
サーバーが混み合っています。
ただいまアクセスが集中しています。
しばらくしてから再度お試しください。
しばらく時間をおいてから再度アクセスしてください。
5分後に再度アクセスしてください。
ただいまメンテナンス中です。
メンテナンス中のため、本文を表示できません。
サービスを一時停止しています。
現在ご利用いただけません。
サーバーに接続できません。
サーバーから応答がありません。
接続がタイムアウトしました。
データベースに接続できませんでした。
リクエストが多すぎます。
お手数ですが、最初からやり直してください。
"""

ORDINARY = """
Group H04L67/02 covers servers that return an error page such as 404 Not Found when a resource is missing.
Methods for detecting that JavaScript is disabled in a browser, and for offering a fallback, go to G06F9/45.
Handling of an expired session, including the prompt to sign in again, is indexed as G06F21/31 with the first aspect.
Template engines that replace a placeholder like title by stored text, e.g.
Filler text of the kind typesetters use to judge a layout has its own place in G06F40/10.
Access denied signals of a door lock, i.e.
Format strings of this kind are covered elsewhere.
Arrangements that show an error message when the access is refused belong here.
Devices for testing whether a server is unavailable are classified in H04L43/08.
The viewer checks whether scripts are enabled and then draws the tree with a canvas element.
Circuits for restarting a controller after a fatal error fall under G06F11/14.
An error page is sent by the web server when a file is missing.
The chapter explains how a browser with disabled scripts renders a form.
The session ends when the user leaves the terminal for ten minutes.
Your session has started.
Your session has 3 parts.
This page cannot be folded.
This page is printed on both sides.
The placeholder is replaced by the value stored in the table.
Apparatus for maintenance of pumps, valves or compressors.
The permission of the owner is kept in the record and read by the gate.
A gateway links the two networks and forwards each request to the host.
The request is answered by the nearest node within a fixed time.
A database holds the codes of all groups and the words of their titles.
The loading of the truck begins when the ramp is lowered.
The page buffer stores one page of the document before printing.
The service interval of the bearing is doubled by this coating.
The error of the measured distance is below two percent.
The connection between the shaft and the sleeve is released by a spring.
Samples of the text are compared with the stored pattern.
The line is scanned in both directions and the result is averaged.
Before moulding, the polymer melt passes a screen of 275 microns.
Devices for rinsing a corrugated housing by means of elements are classified in D01F32/16.
Documents showing a removable sensor array with fittings receive the further code G05B29/10.
Excluded are bodies whose memory bank consists of ceramic powder alone; see F04B18/04.
This place covers labelling of wax emulsion where a layer follows the input pen.
In one form the conveyor is turned by 678 microns so that grains leave the gypsum board.
Whether the mark sits on the electrode or the cover film matters little.
Since release 2008, parts made from bamboo fibre have moved to D21H24/48.
Search fields for preventing corrosion should combine B01J31/32 with the aspect.
The term denotes a heated coupling ring filled with aqueous dispersion.
Operators adjust the gap to 447 degrees before sorting starts.
When measuring takes place beside the electrode, the stage is kept below 653 kHz.
Control of cleaning according to the 112 mm reading of a probe is meant.
Examples include presses, a conductive memory bank and other means for reducing vibration.
Attention is drawn to E02D3/08, which takes units for reducing vibration only.
Where zinc oxide replaces aluminium sheet, the grade decides the place.
Ranges above 382 kPa are rare for assemblies near the cover film.
A member holds the coupling ring while felted wool is supplied from a rotating membrane.
Arrangements in which silica gel is fed to the support frame at 365 degrees belong here.
Cleaning with a tool, for instance on a flexible touch surface, aims at reducing vibration.
Combinations of dispensing and sorting around one axis are indexed under B22F10/08.
The magnetic bearing sleeve carries an insert of cellulose pulp for limiting wear.
Means for improving adhesion, e.g. adjustable heat exchanger
Flexible input pen for simplifying maintenance
The user chooses a colour and the program draws the curve.
See also the notes that follow the title of this class.
Please note that this group does not cover toys.
This group is no longer used; its matter has moved to another place.
The report was written in the spring and printed in May.
The sum over all rows equals the number in the last column.
Heating starts when the door is closed and the timer is set.
Water flows through the pipe into the tank and leaves by the lower valve.
The house stands near the river and has a red roof.
She read the letter twice before she put it away.
We measured the current at each node and wrote it into the table.
The committee met on Monday and agreed on the new text.
The table lists the years, the places and the names of the winners.
Text of the amendment as published in the official gazette.
Themes | Search
Start again with the main group.
Terms of use and notes on the edition.
Next page: notes on the class title.
No drawing is needed for this group.
The number of the ticket is printed on the label.
A list of the files is kept with their sizes and dates.
Nothing in this section limits the scope of the claim.
Line.
Moisture out.
80 litres belong here.
Minutes belong here.
The gap is set to 3 mm.
Gap to
As to cycle.
Wait 5 seconds.
Home
While
Porous display panel
Segmented light guide
Segmented guide rail.
Plate or
A guide rail or plate
Porous signal line
Foamed test strip
Perforated valve seat for extending service life
Tapered housing for extending service life
At saving energy.
B65 F3
Section: 4
Title: the second
Summary: see below.
Name: axle
See label for details.
The page for wheels lists all sizes.
Link to the page of group G06F3/00
存在しない資源に対しエラーを返すサーバはG06F1/00に分類する。
ひな形の差込欄を帳票の本文に置換する装置を含む。
スクリプトが無効であることを検出し代替表示を行うものはG06F1/00を参照。
伏せ字を辞書で補完する処理を含む。
エラーを検出して処理を再開する装置をいう。
セッションの期限を管理する方法はG06F21/00に分類する。
ページの余白を調整する印刷装置を含む。
アクセス権限を管理する装置は除く。
サーバの負荷を測定し、要求を分配するもの。
読み込んだデータを表示部に出力する。
ブラウザに文書を表示する方法。
ダミー電極を備えた検出器をいう。
サンプルを搬送路へ導き、粒子を分ける。
保守を容易にするために、弁座と搬送路との間に片を設ける。
封止と分注とを同一の軸の周りで行うもの。
操作者は間隙を892Vに調整する。
検知器の値が427℃を超えたとき走査を停止する。
樹脂を充填した穿孔した検出器をいう。
本項目には方式による洗浄装置を含む。
シリカゲルに代えてでんぷん糊を用いる場合、等級により区分する。
ただしセラミック体のみからなる導光板は除く。
除外注記が適用される。
2007年の改正により、竹繊維製の部品はC23C34/12へ移行した。
焼結合金を271分で供給し、層を介して貯蔵槽へ導く。
分離の前に水性分散液を処理し、996℃に保つ。
貯蔵槽を833分だけ回転させ、粒子を分ける。
導電性の試験片の例として、圧縮機および噴射口がある。
多孔質のポンプ室に部材を取り付け、温度を一定に保つものはG06F8/08に分類する。
被覆された係止爪は、B29C26/10も参照のこと。
被覆された導光板
この群は玩具を含まない。
表題に続く注記も参照。
報告書は春に書かれ、五月に印刷された。
水は管を通って槽に入り、下の弁から出る。
窓を閉めてから暖房を入れる。
委員会は新しい案を承認した。
改正前の分類は付表に示す。
次の頁に図を示す。
加熱した主軸
加熱した弁座
行した。
受付番号 12
名称: 主軸
軸の説明。
型連結環
型入力ペン
塗布と塗布とを同一の
切断機
"""

#: Names of form fields met in several notations.
SLOT_NAMES = """
name first_name last_name full_name user_name username title subtitle date time year month day address street city country zip email phone company
organization author applicant inventor owner customer client subject topic summary abstract description text content body heading section chapter
version edition code number id url link price amount quantity status remark note comment category value item product
氏名 名前 住所 日付 会社名 題名 件名 番号 電話番号 本文 出願人 発明者 備考
""".split()


def lines(block: str) -> list[str]:
    return [s for s in block.split("\n") if s]
